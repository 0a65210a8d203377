"""Spellings of one thing, within groups: typed edges between spellings, then components.

No rule looks at what another has joined, so each is a query that gives edges, and components close them. Candidates of containment meet on the
rarest word of the shorter one, common words dealt over several tasks; near spellings meet on what is left of a word without one letter.

Rules, in the order of their strength:

- known: names of one known thing that share no word are one;
- owned: a name within a possessive ("X" in "X's rule") joins it if most of its sentences are the longer one's, and never joins it otherwise;
- described: the one longer form that only adds lower-case words or numbers joins a name;
- place, event: the shortest longer forms add only a word of PLACES, or name an event at it, and nothing forbids it (a small word or a hyphen before the name, other families);
- near: a plural, a final e, one letter in one word of several, one letter replaced in a name of one word.

"A and B" with A or B a spelling of its own is no spelling: its sentences count for both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import spelling
from tessera.functions.text import position_in
from tessera.operators.graph import components
from tessera.sources.tables import stored

# Words that a place's name adds, events named by their place, small words within names, and shares.
PLACES = "mountain range river lake island sea bay valley desert peninsula strait gulf canyon basin plateau fall forest ocean".split()
EVENTS = "battle siege treaty sack council massacre fall capture conquest burning".split()
LINKS = "of the de la le del du von van der al".split()
OWNED_SHARE, FULLER_SHARE, LONG_LABEL, SHOWN_WORDS = 0.6, 3, 10, 8
#: Longer forms of one word that meet in one task; letters of a word up to which all its ways to lose one are made.
DEALT, LONG_WORD = 4096, 64
SEP = "\x01"


def one_edit_keys(word: Column) -> Column:
    """Array of keys of which words one edit apart share one: the word without each letter, and itself; halves by length for long words.

    Words of LONG_WORD letters or more have the halves' keys, those of at most LONG_WORD the others, so that two across that length meet, too.
    """
    n = F.length(word)
    left = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    halves = lambda own, of: F.array(F.concat(F.lit(f"{SEP}a"), of.cast("string"), F.lit(SEP), F.left(own, F.floor(of / 2).cast("int"))), F.concat(F.lit(f"{SEP}b"), of.cast("string"), F.lit(SEP), F.right(own, (of - F.floor(of / 2)).cast("int"))))
    none = F.array().cast("array<string>")
    short = F.when(n <= LONG_WORD, F.concat(F.array(word), left)).otherwise(none)
    long = F.when(n >= LONG_WORD, F.concat(halves(word, n - 1), halves(word, n), halves(word, n + 1))).otherwise(none)
    return F.array_distinct(F.concat(short, long))


def near_pairs(keys: DataFrame) -> DataFrame:
    """Pairs (group, a, b), a < b, of distinct keys (group, key: array of words) that are one spelling apart."""
    named = keys.where("size(key) > 0").select("group", "key", F.array_join("key", " ").alias("name")).distinct()
    last = F.element_at("key", -1)
    head = F.array_join(F.slice("key", 1, F.size("key") - 1), " ")
    plural = named.select("group", F.col("name").alias("x"), F.explode(F.transform(F.array(F.lit("s"), F.lit("es")), lambda e: F.trim(F.concat(head, F.lit(" "), last, e)))).alias("name")).join(named.select("group", "name"), ["group", "name"])
    plural = plural.select("group", F.col("x").alias("a"), F.col("name").alias("b"))
    # what stands at a place, by the place and the other words
    at = named.select("group", "name", F.posexplode("key").alias("i", "word"), F.size("key").alias("n"), F.col("key").alias("ws")).where("length(word) >= 4 and (n > 1 or length(word) >= 5)")
    rest = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("i")), F.array(F.lit("*")), F.slice("ws", F.col("i") + 2, F.col("n"))), " ")
    shaped = at.select("group", "name", "word", "n", rest.alias("rest"), F.explode(one_edit_keys(F.col("word"))).alias("left"))
    mine, other = shaped, shaped.select("group", "rest", "left", F.col("name").alias("name2"), F.col("word").alias("word2"))
    met = mine.join(other, ["group", "rest", "left"]).where("name < name2").select("group", "name", "name2", "word", "word2", "n").distinct()
    shorter, longer = F.least(F.length("word"), F.length("word2")), F.greatest(F.length("word"), F.length("word2"))
    final_e = F.when(F.length("word") < F.length("word2"), F.col("word2") == F.concat("word", F.lit("e"))).otherwise(F.col("word") == F.concat("word2", F.lit("e")))
    letters = F.rlike("word", F.lit("^[a-z]*$")) & F.rlike("word2", F.lit("^[a-z]*$"))
    fits = F.when(F.col("n") == 1, letters & (shorter == longer)).otherwise((shorter >= 5) | final_e)
    near = met.where((F.levenshtein("word", "word2", 1) == 1) & fits).select("group", F.col("name").alias("a"), F.col("name2").alias("b"))
    both = plural.unionByName(near)
    return both.select("group", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def contained(spelled: DataFrame) -> DataFrame:
    """(group, short, long, at): spellings whose loose words stand in another's, one behind the other, first at ``at``."""
    each = spelled.select("group", "name", F.explode(F.array_distinct("loose")).alias("word"))
    counts = each.groupBy("group", "word").agg(F.count("*").alias("n"))
    met = stored(each.join(counts, ["group", "word"]))
    parts = F.ceil(F.col("n") / DEALT).cast("int")
    rare = met.groupBy("group", "name").agg(F.min(F.struct("n", "word")).alias("r")).select("group", F.col("name").alias("short"), F.col("r.word").alias("word"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("r.n") / DEALT).cast("int") - 1)).alias("part"))
    longs = met.select("group", "word", F.col("name").alias("long"), F.pmod(F.xxhash64("name"), parts).cast("int").alias("part"))
    pairs = rare.join(longs, ["group", "word", "part"]).where("short <> long").select("group", "short", "long")
    side = lambda c: spelled.select("group", F.col("name").alias(c), F.col("loose").alias(f"{c}_loose"))
    placed = pairs.join(side("short"), ["group", "short"]).join(side("long"), ["group", "long"])
    return placed.withColumn("at", position_in(F.col("long_loose"), F.col("short_loose"))).where("at >= 0").select("group", "short", "long", "at")


def _known_edges(spelled: DataFrame) -> DataFrame:
    """Edges that join what pairs of keys of one known thing without a common word would.

    Two keys that hold the most frequent word are no such pair. A key t without it, of few words, meets every key; two keys that
    share no word with t are joined through it, so that only keys that share one with t need to meet the others.
    """
    own = spelled.where("known is not null").select("group", "known", "name", "key")
    topic = ["group", "known"]
    common = own.select(*topic, F.explode(F.array_distinct("key")).alias("w")).groupBy(*topic, "w").agg(F.count("*").alias("n")).groupBy(*topic).agg(F.max_by("w", F.struct("n", "w")).alias("w"))
    own = own.join(common, topic).withColumn("common", F.array_contains("key", F.col("w"))).drop("w")
    first = own.where("not common").groupBy(*topic).agg(F.min(F.struct(F.size("key").alias("n"), "name", "key")).alias("t")).select(*topic, F.col("t.name").alias("t"), F.col("t.key").alias("t_key"))
    met = own.join(first, topic).withColumn("apart", ~F.arrays_overlap("key", "t_key"))
    left = met.where("not apart and name <> t").select(*topic, F.col("name").alias("a"), F.col("key").alias("a_key"), F.col("common").alias("a_common"))
    pairs = left.join(own, topic).where(~(F.col("a_common") & F.col("common")) & ~F.arrays_overlap("key", "a_key")).select("group", "a", F.col("name").alias("b"))
    return met.where("apart").select("group", F.col("t").alias("a"), F.col("name").alias("b")).unionByName(pairs)


def candidates(mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From mentions (group, form, sentence, known): spellings (group, name, key, loose, form, words, known, n), their forms, and (group, name, sentence).

    A spelling is known by its key's words; its form and known thing are the most frequent ones, the smaller among equals.
    """
    rows = mentions.where("form is not null").groupBy("group", "form", "sentence", "known").agg(F.count("*").alias("times"))
    rows = stored(rows.withColumn("s", spelling(F.col("form"))).withColumn("name", F.array_join("s.key", " ")).where("name <> ''"))
    forms = rows.groupBy("group", "name", "form").agg(F.sum("times").alias("times"), F.any_value("s").alias("s"))
    best = forms.groupBy("group", "name").agg(F.min_by(F.struct("form", "s"), F.struct(-F.col("times"), "form")).alias("b"))
    named = rows.where("known is not null").groupBy("group", "name", "known").agg(F.sum("times").alias("k")).groupBy("group", "name").agg(F.min_by("known", F.struct(-F.col("k"), "known")).alias("known"))
    said = stored(rows.select("group", "name", "sentence").distinct())
    spelled = best.select("group", "name", "b.s.key", "b.s.loose", "b.form", "b.s.words", "b.s.flat").join(named, ["group", "name"], "left").join(said.groupBy("group", "name").agg(F.count("*").alias("n")), ["group", "name"])
    return stored(spelled), stored(forms.select("group", "name", "form", "s.flat", "s.owner")), said


def edges(spelled: DataFrame, forms: DataFrame, said: DataFrame) -> DataFrame:
    """Edges (group, a, b, rule) between names of spellings."""
    inside = contained(spelled)
    short_side = spelled.select("group", F.col("name").alias("short"), F.col("key").alias("sk"), F.col("loose").alias("sl"), F.col("form").alias("sf"), F.col("known").alias("s_known"), F.col("n").alias("s_n"))
    long_side = spelled.select("group", F.col("name").alias("long"), F.col("key").alias("lk"), F.col("loose").alias("ll"), F.col("form").alias("lf"), F.arrays_zip("words", "flat").alias("lw"), F.col("known").alias("l_known"))
    pairs = inside.join(short_side, ["group", "short"]).join(long_side, ["group", "long"])
    tail = position_in(F.col("flat"), F.col("sl"))
    owns = pairs.select("group", "short", "long", "sl").join(forms.withColumnRenamed("name", "long"), ["group", "long"]).where((tail >= 0) & F.get("owner", (tail + F.size("sl") - 1).cast("int"))).select("group", "short", "long").distinct().withColumn("owned", F.lit(True))
    pairs = stored(pairs.join(owns, ["group", "short", "long"], "left").withColumn("owned", F.coalesce("owned", F.lit(False))))

    both = pairs.where("owned").select("group", "short", "long", "s_n").join(said.withColumnRenamed("name", "short"), ["group", "short"]).join(said.withColumnRenamed("name", "long"), ["group", "long", "sentence"])
    owned = both.groupBy("group", "short", "long", "s_n").agg(F.count("*").alias("m")).where(F.col("m") >= OWNED_SHARE * F.col("s_n"))
    out = [owned.select("group", F.col("short").alias("a"), F.col("long").alias("b"), F.lit("owned").alias("rule"))]

    free = pairs.where("not owned")
    extra = F.transform(F.filter("lw", lambda w: ~F.array_contains("sl", w["flat"])), lambda w: w["words"])
    describes = (F.size(extra) > 0) & F.forall(extra, lambda w: F.rlike(w, F.lit(r"^(?:\p{Ll}|[0-9]+$)")))
    anchors = (F.size("sk") > 1) | F.rlike("sf", F.lit(r"^\p{Lu}"))
    described = free.where(describes & anchors)
    one = described.groupBy("group", "short").agg(F.countDistinct("ll").alias("m")).where("m = 1").select("group", "short")
    out.append(described.join(one, ["group", "short"]).select("group", F.col("short").alias("a"), F.col("long").alias("b"), F.lit("described").alias("rule")))

    same = stored(free.where("s_known is null or s_known = l_known"))
    links = same.select("group", "short", "long")
    # a longer form that holds another of the same name isn't one of the shortest
    holds = inside.select("group", F.col("short").alias("inner"), "long")
    not_least = links.join(holds, ["group", "long"]).join(links.select("group", "short", F.col("long").alias("inner")), ["group", "short", "inner"]).select("group", "short", "long").distinct()
    least = same.join(not_least, ["group", "short", "long"], "left_anti")
    places = F.array(*map(F.lit, PLACES))
    event = (F.col("at") == 2) & F.get("ll", F.lit(0)).isin(*EVENTS)
    linked = (F.col("at") > 0) & F.get("lk", F.col("at") - 1).isin(*LINKS)
    glued = F.rlike(F.lower("lf"), F.concat(F.lit(r"-\s*"), F.regexp_replace(F.lower(F.get(F.split("sf", " "), F.lit(0))), r"([^\p{L}\p{N}\s])", r"\\$1")))
    other = F.when(linked, ~((F.col("at") == 2) & F.get("lk", F.lit(0)).isin(*EVENTS))).otherwise(glued)
    judged = least.groupBy("group", "short").agg(
        F.countDistinct(F.filter("ll", lambda w: ~w.isin(*PLACES))).alias("families"), F.bool_or(other).alias("other"), F.bool_and(anchors).alias("anchors"),
        F.bool_and(F.size(F.array_except(F.array_except("ll", "sl"), places)) == 0).alias("place"), F.bool_and(event).alias("event"),
    )
    told = judged.where("families = 1 and not other and anchors and (place or event)").select("group", "short", F.when(F.col("place"), "place").otherwise("event").alias("rule"))
    out.append(links.join(told, ["group", "short"]).select("group", F.col("short").alias("a"), F.col("long").alias("b"), "rule"))
    out.append(near_pairs(spelled.select("group", "key")).withColumn("rule", F.lit("near")))
    out.append(_known_edges(spelled).withColumn("rule", F.lit("known")))
    return reduce(DataFrame.unionByName, out).select("group", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rule").distinct()


def _halves(spelled: DataFrame) -> DataFrame:
    """(group, name, side, text) of "A and B" where A or B is a spelling; text is how the form writes that side."""
    at = F.array_position("key", "and").cast("int")
    pairs = spelled.where((at > 1) & (at < F.size("key")))
    side = lambda words, k: F.struct(F.array_join(words, " ").alias("side"), F.get(F.split("form", r"\s+and\s+", 2), F.lit(k)).alias("text"))
    both = pairs.select("group", "name", F.explode(F.array(side(F.slice("key", F.lit(1), at - 1), 0), side(F.slice("key", at + 1, F.size("key")), 1))).alias("h")).select("group", "name", "h.*")
    found = both.join(spelled.select("group", F.col("name").alias("side")), ["group", "side"], "left_semi").select("group", "name").distinct()
    return both.join(found, ["group", "name"], "left_semi")


def merged(mentions: DataFrame) -> DataFrame:
    """(group, name, form, n, root) of all spellings of mentions (group, form, sentence, known): spellings of one thing have one root.

    n counts distinct sentences, those of "A and B" for A and for B; B that is no spelling of its own becomes one. root is the smallest name of the
    component. Null forms and forms without a word are left out; null groups are a group.
    """
    mentions = mentions.select(F.coalesce(F.col("group").cast("string"), F.lit("")).alias("group"), "form", "sentence", "known")
    spelled, forms, said = candidates(mentions)
    found = stored(edges(spelled, forms, said))
    halves = stored(_halves(spelled))
    split = halves.select("group", "name").distinct()
    node = lambda c: F.concat("group", F.lit(SEP), F.col(c))
    roots = components(found.select(node("a").alias("a"), node("b").alias("b")))
    # the names that stay: those that aren't split, and sides that were none
    kept = spelled.select("group", "name", "form").join(split, ["group", "name"], "left_anti")
    new = halves.where("text <> ''").join(spelled.select("group", F.col("name").alias("side")), ["group", "side"], "left_anti").groupBy("group", "side").agg(F.min("text").alias("form"))
    names = kept.unionByName(new.select("group", F.col("side").alias("name"), "form"))
    counted = said.join(split, ["group", "name"], "left_anti").unionByName(said.join(halves.select("group", "name", "side"), ["group", "name"]).select("group", F.col("side").alias("name"), "sentence"))
    counts = counted.distinct().groupBy("group", "name").agg(F.count("*").alias("n"))
    placed = names.join(counts, ["group", "name"]).withColumn("id", node("name")).join(roots, "id", "left").withColumn("top", F.coalesce("root", "id"))
    least = placed.groupBy("top").agg(F.min("name").alias("root"))
    return placed.drop("root", "id").join(least, "top").select("group", "name", "form", "n", "root")


def labelled(groups: DataFrame) -> DataFrame:
    """(group, root, label, n_spellings) of merged spellings (group, name, form, n, root).

    The label is the form of the name with most sentences, the fuller among equals; a fuller name that holds it, adds capitals or an owner, and has a third as
    many sentences at least, is taken instead, the longest first. Forms of more than LONG_LABEL words show SHOWN_WORDS of them.
    """
    rows = groups.withColumn("s", spelling(F.col("form")))
    size = F.size(F.split("name", " "))
    main = rows.groupBy("group", "root").agg(F.max_by(F.struct("name", "form", "n", "s"), F.struct("n", size, "name")).alias("m"), F.count("*").alias("n_spellings"))
    met = rows.join(main, ["group", "root"])
    ws, own = F.split("name", " "), F.split("m.name", " ")
    added = F.transform(F.filter(F.arrays_zip("s.words", "s.flat"), lambda w: ~F.array_contains(own, w["flat"])), lambda w: w["words"])
    owner = F.exists("s.owner", lambda o: o)
    fuller = (F.size(ws) > F.size(own)) & (position_in(ws, own) >= 0) & (F.size(added) > 0) & (owner | F.forall(added, lambda w: F.rlike(w, F.lit(r"^\p{Lu}")))) & (F.col("n") * FULLER_SHARE >= F.col("m.n"))
    best = met.groupBy("group", "root", "n_spellings").agg(F.max_by("form", F.when(fuller, F.struct(size, "name"))).alias("longer"), F.any_value("m.form").alias("main"))
    form = F.coalesce("longer", "main")
    words = F.split(form, r"\s+")
    return best.select("group", "root", F.when(F.size(words) > LONG_LABEL, F.concat(F.array_join(F.slice(words, 1, SHOWN_WORDS), " "), F.lit("…"))).otherwise(form).alias("label"), "n_spellings")
