"""Names of topics in texts: longest first, each for the topic that it means there.

Grams of a text's tokens that are names come with their place and neighbours from one Arrow pass and meet the dictionary by a join. A name with several
owners goes to one by rules over counts: how many owners it has, in the text's category, with it as their own name, as a title. The counts are
sums, so one owner can be left out of them (a rejected answer never means the question's own topic) without gathering owners. Grams whose
owner, capitals or neighbours refuse them are dropped before the longest is taken, so a shorter name takes its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import folded, tokenized
from tessera.operators.dictionary import BROADCAST_BYTES
from tessera.sources.tables import stored

# Words that names are not told by, words that no name ends with, and bounds.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from has have he her his i if in into is it its me my no not of on or our she so that the their them they this to us was we were what when where which who why will with you your all one two new old".split()
)
NO_LAST = frozenset("of the and to in for with by from at on as or an is are was were be s".split())
MOST_WORDS, SHORTEST, MANY_TOPICS, TRUSTED = 8, 4, 300, 1.0
NAME_SOURCES, ANSWER_SOURCES = ("title", "main"), ("accept", "required")
GRAM = "array<struct<at:int,n:int,key:string,start:int,end:int,capitals:boolean,beside:boolean,lead:string>>"
SEEN = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("key", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("capitals", pa.bool_()), ("beside", pa.bool_()), ("lead", pa.string())]))


def is_proper(form: str) -> bool:
    """Whether every word that isn't a stop word begins with a capital or a digit, and there is one."""
    words = [form[a:b] for k, a, b, _ in tokenized(form) if form[a:b] != "&" and form[a:b].lower() not in STOP_WORDS]
    return bool(words) and all(w[0].isupper() or w[0].isdigit() for w in words)


def usable(key: Column) -> Column:
    """Whether a folded name can be looked for: SHORTEST characters, no mere number, no article first, no small word last, MOST_WORDS words at most."""
    ws = F.split(key, " ")
    return (F.length(key) >= SHORTEST) & ~F.rlike(key, F.lit("^[0-9 ]*$")) & ~F.get(ws, F.lit(0)).isin("a", "an", "the") & ~F.element_at(ws, -1).isin(*NO_LAST) & (F.size(ws) <= MOST_WORDS)


def grams(text: str, lengths: list[int], firsts: frozenset[str] | None) -> Iterator[dict]:
    """Grams of the tokens that begin with one of ``firsts`` (any, where it is None).

    capitals: all but stop words begin with a capital; beside: a capitalised word that is no stop word stands next to it, so that it is part of a longer
    name; the text's first word, which is capitalised anyway, is told apart as ``lead``.
    """
    tokens = tokenized(text)
    names = [capital and key not in STOP_WORDS for key, _, _, capital in tokens]
    plain = [capital or key in STOP_WORDS for key, _, _, capital in tokens]
    for i, (key, start, _, _) in enumerate(tokens):
        if firsts is not None and key not in firsts:
            continue
        for n in lengths:
            j = i + n
            if j > len(tokens):
                break
            beside = i > 1 and names[i - 1] or j < len(tokens) and names[j]
            yield {"at": i, "n": n, "key": " ".join(t[0] for t in tokens[i:j]), "start": start, "end": tokens[j - 1][2], "capitals": all(plain[i:j]), "beside": beside, "lead": tokens[0][0] if i == 1 and names[0] else None}


def _gram_column(text: Column, lengths: list[int], firsts: frozenset[str] | None) -> Column:
    @F.arrow_udf(GRAM)
    def seen(texts: pa.Array) -> pa.Array:
        return pa.array([list(grams(t.as_py() or "", lengths, firsts)) for t in texts], SEEN)

    return seen(text)


def dictionary(rows: DataFrame, capitalised: DataFrame | None = None, least_share: float = 0.7) -> DataFrame:
    """Names (key, owner, category, proper, weak, single, title, own, usable) from rows (owner, category, alias, source, weight).

    Of an owner's rows of one key, answers count from a weight of TRUSTED on; a name is proper if its best form is written so. One-word names are
    proper, weak unless a title all in capitals, and looked for only if ``capitalised`` (word, share) has them with least_share or more.
    """

    @F.arrow_udf("struct<key:string,proper:boolean>")
    def read(forms: pa.Array) -> pa.Array:
        return pa.array([{"key": folded(f or "").removeprefix("the ").removeprefix("a ").removeprefix("an "), "proper": is_proper(f or "")} for f in forms.to_pylist()], pa.struct([("key", pa.string()), ("proper", pa.bool_())]))

    each = rows.where("alias is not null and owner is not null").withColumn("r", read("alias")).select("owner", "category", "alias", "source", "weight", "r.*").where(usable(F.col("key")))
    found = ~F.col("source").isin(*ANSWER_SOURCES) | (F.col("weight") >= TRUSTED)
    named = found & F.col("source").isin(*NAME_SOURCES)
    best = F.struct(named.cast("int"), found.cast("int"), F.coalesce("weight", F.lit(0.0)), "alias")
    loud = (F.col("alias") == F.upper("alias")) & (F.col("alias") != F.lower("alias"))
    out = each.groupBy("key", "owner").agg(
        F.min("category").alias("category"), F.max_by("proper", best).alias("proper"), F.bool_or(named).alias("own"), F.bool_or(found).alias("usable"), F.bool_or(found & (F.col("source") == "title")).alias("title"), F.bool_or(found & (F.col("source") == "title") & loud).alias("loud"),
    )
    single = ~F.col("key").contains(" ")
    out = out.withColumn("single", single).withColumn("proper", F.col("single") | F.col("proper")).withColumn("weak", F.when(F.col("single"), ~F.col("loud")).otherwise(~F.col("own") & ~F.col("proper"))).drop("loud")
    if capitalised is not None:
        known = capitalised.where(F.col("share") >= least_share).select(F.col("word").alias("key"))
        out = out.where("not single").unionByName(out.where("single").join(known, "key", "left_semi"))
    return out


def _counts(names: DataFrame, by: list[str]) -> DataFrame:
    """For each key (and category) how many owners are of each sort, with the smallest and the largest of them."""
    sorts = {"every": F.lit(True), "fit": F.col("usable"), "strong": F.col("usable") & ~F.col("weak"), "titled": F.col("usable") & ~F.col("weak") & F.col("title"), "own": F.col("own"), "own_fit": F.col("own") & F.col("usable")}
    made = []
    for name, of in sorts.items():
        owner = F.when(of, F.col("owner"))
        made.append(F.struct(F.count(owner).alias("n"), F.min(owner).alias("low"), F.max(owner).alias("high")).alias(name))
    return names.groupBy(*by).agg(*made, F.bool_or("single").alias("single"))


def choose(asked: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (key, category, exclude) with the owner that the key means there; rows without one are left out."""
    over = _counts(names, ["key"])
    local = _counts(names, ["key", "category"]).withColumnRenamed("category", "at").drop("single").withColumnsRenamed({c: f"l_{c}" for c in ("every", "fit", "strong", "titled", "own", "own_fit")}).withColumnRenamed("key", "l_key")
    gone = names.select(F.col("key").alias("x_key"), F.col("owner").alias("x_owner"), F.col("category").alias("x_category"), *[F.col(c).alias(f"x_{c}") for c in ("own", "usable", "weak", "title")])
    rows = asked.join(over, "key").join(local, (F.col("key") == F.col("l_key")) & F.col("category").eqNullSafe(F.col("at")), "left")
    rows = rows.join(gone, (F.col("key") == F.col("x_key")) & (F.col("exclude") == F.col("x_owner")), "left")
    out = F.col("x_owner").isNotNull()
    near = out & F.col("x_category").eqNullSafe(F.col("category"))
    fit, strong = F.col("x_usable"), F.col("x_usable") & ~F.col("x_weak")

    def left(sort: str, counted: Column) -> tuple[Column, Column]:
        """How many owners of a sort are left without the excluded one, and the least (the only one, if one)."""
        counted = F.coalesce(counted, F.lit(False))
        n = F.coalesce(F.col(sort)["n"], F.lit(0)) - counted.cast("int")
        return n, F.when(counted & (F.col(sort)["low"] == F.col("exclude")), F.col(sort)["high"]).otherwise(F.col(sort)["low"])

    every, fits, strongs, titled = left("every", out), left("fit", out & fit), left("strong", out & strong), left("titled", out & strong & F.col("x_title"))
    here, here_fit, own, own_fit = left("l_every", near), left("l_fit", near & fit), left("l_own", near & F.col("x_own")), left("l_own_fit", near & F.col("x_own") & fit)
    only = lambda s: F.when(s[0] == 1, s[1])
    its_own = F.when(own[0] == 1, only(own_fit))
    several = F.when(F.col("single"), F.coalesce(its_own, only(strongs))).when(here[0] == 1, only(here_fit)).when(here[0] > 1, its_own).otherwise(only(titled))
    return rows.withColumn("owner", F.when(every[0] == 1, only(fits)).when(every[0] > 1, several)).where("owner is not null").select(*asked.columns, "owner")


def _taken(places: Column) -> Column:
    """Of places (at, n, ...) in order of place, longest first, those that don't reach into one taken before."""

    @F.arrow_udf("array<boolean>")
    def flags(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():
            free, kept = 0, []
            for p in row:
                ok = p["at"] >= free
                free = p["at"] + p["n"] if ok else free
                kept.append(ok)
            out.append(kept)
        return pa.array(out, pa.list_(pa.bool_()))

    return flags(places)


def find(texts: DataFrame, names: DataFrame, name_like: DataFrame) -> DataFrame:
    """(id, key, owner, start, end) of the names in texts (id, text, category, exclude), left to right, longest first.

    name_like (word): words usually capitalised within sentences; such a first word of a text makes a longer name. Null texts have no names. The names
    of one text meet in one row, all others are spread by their keys.
    """
    names = stored(names)
    sizes = names.agg(F.collect_set(F.size(F.split("key", " "))).alias("n"), F.sum(F.length("key")).alias("bytes")).first()
    firsts = None
    if (sizes["bytes"] or 0) <= BROADCAST_BYTES:  # a bounded dictionary: only grams that can be names are made
        firsts = frozenset(r.w for r in names.select(F.get(F.split("key", " "), F.lit(0)).alias("w")).distinct().collect())
    seen = texts.select("id", "category", "exclude", F.explode(_gram_column(F.col("text"), sorted(sizes["n"]), firsts)).alias("g")).select("id", "category", "exclude", "g.*")
    seen = stored(seen.join(names.select("key").distinct(), "key", "left_semi"))
    asked = choose(seen.select("key", "category", "exclude").distinct(), names)
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("key", "category", "exclude")]
    met = seen.alias("s").join(asked.alias("c"), same[0] & same[1] & same[2]).select("s.*", "c.owner")
    sort = names.select("key", "owner", "proper", "weak", F.col("category").alias("its"))
    met = met.join(sort, ["key", "owner"])
    lead = name_like.select(F.col("word").alias("lead")).distinct().withColumn("longer", F.lit(True))
    met = met.where("lead is null").withColumn("longer", F.lit(False)).unionByName(met.where("lead is not null").join(lead, "lead", "left").withColumn("longer", F.coalesce("longer", F.lit(False))).select(*met.columns, "longer"))
    fits = (~F.col("proper") | (F.col("capitals") & ~F.col("beside") & ~F.col("longer"))) & (~F.col("weak") | F.col("its").eqNullSafe(F.col("category")))
    rows = met.where(fits).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "n", "key", "owner", "start", "end"))).alias("m"))
    flagged = rows.select("id", F.explode(F.arrays_zip("m", _taken(F.col("m")).alias("ok"))).alias("x")).where("x.ok")
    return flagged.select("id", "x.m.key", "x.m.owner", "x.m.start", "x.m.end")


def without_generic(found: DataFrame, names: DataFrame, topics: DataFrame, most: int = MANY_TOPICS) -> DataFrame:
    """Mentions but for those of names that aren't proper and stand in texts (id, topic) of more than ``most`` topics."""
    plain = names.where("not proper").select("key", "owner")
    spread = found.join(plain, ["key", "owner"], "left_semi").join(topics, "id").select("key", "topic").distinct().groupBy("key").agg(F.count("*").alias("n"))
    return found.join(spread.where(F.col("n") > most).select("key"), "key", "left_anti")


def reject_targets(entries: DataFrame, names: DataFrame, name_like: DataFrame) -> DataFrame:
    """(id, owner) of entries (id, text, category, exclude): what the whole entry names, else what names of half its words or more name; never ``exclude``."""

    @F.arrow_udf("struct<key:string,content:int>")
    def read(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            tokens = tokenized(t or "")
            out.append({"key": folded(t or "").removeprefix("the ").removeprefix("a ").removeprefix("an "), "content": sum(k not in STOP_WORDS for k, *_ in tokens)})
        return pa.array(out, pa.struct([("key", pa.string()), ("content", pa.int32())]))

    rows = stored(entries.withColumn("r", read("text")).select("id", "text", "category", "exclude", "r.*"))
    whole = choose(rows.select("id", "key", "category", "exclude"), names).select("id", "owner")
    rest = rows.join(whole.select("id"), "id", "left_anti")
    parts = find(rest.select("id", "text", "category", "exclude"), names, name_like).join(rest.select("id", "content"), "id")
    return whole.unionByName(parts.where(2 * F.size(F.split("key", " ")) >= F.col("content")).select("id", "owner")).distinct()
