"""Alias tables: which spellings of a name stand for which canonical one, from cast records, glossaries, observed names and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stages import Scratch
from .matching import fuzzy_match

#: What introduces variants of a name in parentheses.
_MARKS = "ASR|OCR|alias|còn gọi|tên khác|nhận nhầm"
_SEED, _RECORD, _GLOSSARY, _OBSERVED = range(4)


def clean_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", " "))


def split_aliases(c: Column) -> Column:
    """The spellings in a text: parts at slash, semicolon, pipe and comma, without blanks and quotes around them."""
    parts = F.transform(F.split(clean_name(c), "\\s*[/;|,]\\s*"), lambda x: F.btrim(x, F.lit(" \t\r\n\"'")))
    return F.filter(parts, lambda x: x != "")


def parse_character(c: Column) -> tuple[Column, Column]:
    """Name and aliases of a description such as ``Name (ASR: variant, other): who that is``."""
    inside = F.regexp_extract_all(c, F.lit(f"(?iU)\\((?:{_MARKS})[^:)]*:\\s*([^)]+)\\)"), F.lit(1))
    bare = F.regexp_replace(F.trim(c), f"(?isU)\\s*\\((?=(?:{_MARKS})\\b).*", "")
    return F.trim(F.split(bare, ":", 2)[0]), F.flatten(F.transform(inside, split_aliases))


def contained_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``(video_id, entry_no, name)``: the longest of a video's ``names(video_id, name, at)`` that is within a text, as whole words.

    ``texts(video_id, entry_no, text)``. Names are found by all their words: a join of the texts' runs of as many words as some name of the
    video has. Of equally long names the first by ``at``.
    """
    words = lambda c: F.split(T.name_key(c), " ")
    n = names.select("video_id", "name", "at", words("name").alias("own")).where(F.col("own")[0] != "")
    best = F.min_by(F.struct((-F.length("name")).alias("k"), "at", "name"), F.struct(-F.length("name"), "at", "name")).alias("x")
    sizes = n.groupBy("video_id").agg(F.collect_set(F.size("own")).alias("sizes"))
    n = n.groupBy("video_id", F.array_join("own", " ").alias("run")).agg(best)
    t = texts.select("video_id", "entry_no", words("text").alias("words")).where(F.col("words")[0] != "")
    t = t.join(sizes.hint("merge"), "video_id").select("video_id", "entry_no", "words", F.explode("sizes").alias("n")).where(F.size("words") >= F.col("n"))
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.array_join(F.slice("words", i, F.col("n")), " "))
    hit = t.select("video_id", "entry_no", F.explode(F.array_distinct(runs)).alias("run")).join(n.hint("merge"), ["video_id", "run"])
    return hit.groupBy("video_id", "entry_no").agg(F.min("x").alias("x")).select("video_id", "entry_no", "x.name")


def _registered(units: DataFrame, scratch: Scratch) -> DataFrame:
    """Units with their canonical name, in the order in which they came.

    ``units(video_id, kind, no, part, name, aliases)``. A name whose key an earlier spelling has takes that one's canonical name. A key belongs to the
    first unit that spells it, and this unit has its own name or that of an earlier one: links from key to key, which are followed in
    rounds, each twice as far as the one before, until all end at a unit with its own name. A round's table has a row for each key.
    """
    unit = units.withColumn("key", T.name_key("name")).withColumn("keys", F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), T.name_key)))
    unit = scratch.table(unit, "units")
    first = F.min(F.struct("kind", "no", "part", "name", "key")).alias("x")
    k = unit.select("video_id", "kind", "no", "part", "name", F.col("key").alias("own"), F.explode("keys").alias("key")).where("key <> ''").withColumnsRenamed({"key": "of", "own": "key"}).groupBy("video_id", "of").agg(first)
    own = (F.col("x.key") == "") | (F.col("x.key") == F.col("of"))
    k = scratch.table(k.select("video_id", "of", F.when(~own, F.col("x.key")).alias("to"), F.when(own, F.col("x.name")).alias("canonical")), "keys-0")
    i = 0
    while not k.where("to IS NOT NULL").isEmpty():
        i += 1
        far = k.select("video_id", F.col("of").alias("to"), F.col("to").alias("next"), F.col("canonical").alias("found"))
        k = k.join(far.hint("merge"), ["video_id", "to"], "left").select("video_id", "of", F.col("next").alias("to"), F.coalesce("canonical", "found").alias("canonical"))
        k = scratch.table(k, f"keys-{i}")
    done = unit.drop("keys").join(k.select("video_id", F.col("of").alias("key"), "canonical").hint("merge"), ["video_id", "key"], "left")
    return done.select("video_id", "kind", "no", "part", "name", "aliases", F.coalesce("canonical", "name").alias("canonical"))


def _spelled(rows: DataFrame) -> DataFrame:
    """``(video_id, alias, canonical, at)``: the canonical name itself, each alias, and its form without marks if that has four letters or more, where first."""
    solid = lambda c: F.length(F.replace(c, F.lit(" ")))

    def forms(a: Column) -> Column:
        plain = T.without_marks(a)
        return F.when(F.length(F.replace(T.name_key(a), F.lit(" "))) < 2, F.array().cast("array<string>")).when((plain != a) & (solid(plain) >= 4), F.array(a, plain)).otherwise(F.array(a))

    every = F.concat(F.array("canonical"), F.flatten(F.transform("aliases", forms)))
    d = rows.select("video_id", "kind", "no", "part", F.posexplode(every).alias("pos", "alias"), "canonical").where("canonical <> ''")
    return d.groupBy("video_id", "alias", "canonical").agg(F.min(F.struct("kind", "no", "part", "pos")).alias("at"))


def build_aliases(records: DataFrame, glossary: DataFrame, observed: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(video_id, alias, canonical, kind)``: one canonical name for each spelling of a video; ``kind`` says where it came from.

    ``records(video_id, no, name, aliases)`` in the order of ``no``, ``glossary(video_id, no, source, target)``, ``observed(video_id, no, name)``, ``seeds(video_id, no, canonical, aliases)``.
    Seeds come first, then records, glossary entries and observed names; the first to name a spelling keeps it. A record's name at which
    slashes separate identities gives one for each; else it and its aliases, split at slash, semicolon, pipe and comma, stand
    for the name, or for the canonical one that an earlier spelling with the same key has. A glossary's source stands for the
    longest canonical name within its target. An observed name with no key among these takes the one canonical name that matches it
    clearly (``fuzzy_match``), else it is a name of its own. Defined cases: null and empty names are left out; null lists count as
    empty; spellings of a single letter only count as names; observed names that start with UNKNOWN are left out and are not
    matched with each other but by equal keys; a name that merely contains an earlier spelling stays as it is.
    """
    none = F.array().cast("array<string>")
    name = clean_name(F.col("name"))
    s = seeds.select("video_id", F.lit(_SEED).alias("kind"), "no", F.lit(0).alias("part"), clean_name(F.col("canonical")).alias("name"), F.coalesce("aliases", none).alias("aliases"))
    parts = F.filter(F.split(name, "\\s*/\\s*"), lambda x: F.trim(x) != "")
    r = records.select("video_id", F.lit(_RECORD).alias("kind"), "no", name.alias("raw"), parts.alias("parts"), F.coalesce("aliases", none).alias("aliases"))
    r = r.select("video_id", "kind", "no", F.posexplode("parts").alias("part", "name"), F.when(F.size("parts") > 1, none).otherwise(F.concat(F.array("raw"), "aliases")).alias("aliases"))
    r = r.withColumn("name", F.trim("name")).withColumn("aliases", F.when(F.size("aliases") == 0, F.array("name")).otherwise(F.col("aliases")))
    split = F.flatten(F.transform("aliases", split_aliases))
    # Equal units and names stand for the first of them, so that what follows grows with the different ones.
    units = s.unionByName(r).where("name <> ''").withColumn("aliases", split)
    units = units.groupBy("video_id", "kind", "name", "aliases").agg(F.min(F.struct("no", "part")).alias("x")).select("video_id", "kind", "x.no", "x.part", "name", "aliases")
    scratch = Scratch(records.sparkSession, "aliases")
    own = scratch.table(_spelled(_registered(units, scratch)), "own")
    firsts = own.groupBy("video_id", "canonical").agg(F.min("at").alias("at"))
    names = firsts.select("video_id", F.col("canonical").alias("name"), "at")
    targets = glossary.select("video_id", F.col("target").alias("entry_no"), F.col("target").alias("text")).distinct()
    g = contained_names(targets, names).withColumnsRenamed({"entry_no": "target", "name": "canonical"})
    g = glossary.select("video_id", "no", "target", split_aliases(F.col("source")).alias("aliases")).join(g.hint("merge"), ["video_id", "target"])
    own = scratch.table(own.unionByName(_spelled(g.withColumns({"kind": F.lit(_GLOSSARY), "part": F.lit(0)}))), "glossary")
    o = observed.select("video_id", "no", name.alias("name")).where((F.col("name") != "") & ~F.upper("name").startswith("UNKNOWN"))
    o = o.groupBy("video_id", "name").agg(F.min("no").alias("no")).withColumn("key", T.name_key("name"))
    key = own.groupBy("video_id", T.name_key("alias").alias("key")).agg(F.min_by("canonical", "at").alias("known"))
    o = o.join(key.hint("merge"), ["video_id", "key"], "left").withColumn("first", F.first("name").over(Window.partitionBy("video_id", "key").orderBy("no")))
    o = scratch.table(o, "observed")
    lone = o.where("known IS NULL").select("video_id", F.col("first").alias("name")).distinct()
    like = fuzzy_match(lone, names.select("video_id", "name")).select("video_id", F.col("name").alias("first"), F.col("canonical").alias("like"))
    o = o.join(like.hint("merge"), ["video_id", "first"], "left").withColumn("canonical", F.coalesce("known", "like", "first"))
    own = own.unionByName(_spelled(o.select("video_id", F.lit(_OBSERVED).alias("kind"), "no", F.lit(0).alias("part"), split_aliases(F.col("name")).alias("aliases"), "canonical")))
    best = own.groupBy("video_id", "alias").agg(F.min_by(F.struct("canonical", F.col("at.kind")), "at").alias("x"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("seed", "record", "glossary", "observed")]), F.col("x.kind") + 1)
    return best.select("video_id", "alias", "x.canonical", kinds.alias("kind"))
