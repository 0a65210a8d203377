"""Edits of a topic's clues: checked against what is there, merge chains followed, counts taken anew from the questions.

Tables (all keyed by `topic`; any column may be null, rows without a topic or key are left out by the joins):

- clues: topic, id, label, rank (no ties within a topic);
- spellings: topic, id, spelling, question; a row for each use;
- sources: topic, id, text; texts whose words a new label may use;
- edits: topic, seq (no ties), id, action (drop, merge, rename, keep), into, label, remove (array of spellings);
- groups: topic, answer_group, answer, category, question; a row for each question, which is in one group;
- topics: topic, title, category; off: topic, seq, answer_group, the groups said to be off the topic.

Of several edits of one id that do the same, the last one holds. A clue that is dropped isn't merged as well.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import fold
from tessera.operators.places import numbered, running
from tessera.sources.tables import stored

# Words that say nothing in a label, words a label may have, the share of questions that off-topic groups may take.
STOP = "a an the of and or in on at to for by with from as is was this these that".split()
LABEL_WORDS, EXCLUDED_SHARE = 27, 0.5
#: Letters of a new label's word that may be a corrected one, letters of the word it corrects, difference in letters, likeness.
NEW_LETTERS, OLD_LETTERS, LETTERS_APART, WORD_LIKENESS = 5, 4, 2, 0.8


def words(text: Column) -> Column:
    """Distinct folded words, with hyphens and apostrophes inside, without STOP."""
    plain = F.regexp_replace(fold(text), r"[^\x00-\x7F’]", "")
    found = F.regexp_extract_all(plain, F.lit(r"\w++(?:['’-]\w++)*+"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP)))


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters of the matching blocks by those of both words."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def names_topic(answer: Column, title: Column) -> Column:
    """Whether an answer has every word of a title, its parentheses aside, and at most two words that neither has; a last s doesn't count."""
    stems = lambda t: F.array_distinct(F.transform(words(t), lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.left(w, F.length(w) - 1)).otherwise(w)))
    bare = F.regexp_replace(title, r"\s*\(.*\)$", "")
    want, also, have = stems(bare), stems(F.regexp_extract(title, r"\((.*)\)", 1)), stems(answer)
    named = (F.size(want) > 0) & (F.size(F.array_except(want, have)) == 0) & (F.size(F.array_except(have, F.concat(want, also))) <= 2)
    return F.coalesce(named, F.lit(False))


def _last(edits: DataFrame, *values: str) -> DataFrame:
    """(topic, id, seq of the first, values of the last) of edits of one kind."""
    last = F.max_by(F.struct(*values), "seq").alias("last")
    return edits.groupBy("topic", "id").agg(F.min("seq").alias("seq"), last).select("topic", "id", "seq", "last.*")


def settled(merges: DataFrame, drops: DataFrame) -> DataFrame:
    """(topic, id, home) of merges (topic, id, seq, into); home is null where a merge is undone.

    A chain that ends in a clue that stays leads there. In one that ends in a dropped clue or a cycle, merges are undone in the order of
    seq until the rest ends: those that come before all others ahead of them. The others lead to the earliest ahead.
    Jumps double in each round, so a chain of n takes log n rounds of joins by (topic, id); a hot target only repeats a row on its own side.
    """
    steps = merges.select("topic", "id", "seq", F.col("into").alias("jump"))
    ahead = steps.select("topic", F.col("id").alias("jump"), F.struct("seq", F.col("id").alias("at")).alias("first"))
    state = stored(steps.join(ahead, ["topic", "jump"], "left").select("topic", "id", "seq", "jump", "first", F.col("first").isNull().alias("ended")))
    while True:
        onward = state.select("topic", F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("first").alias("first2"), F.col("ended").alias("ended2"))
        doubled = state.join(onward, ["topic", "jump"], "left").select(
            "topic", "id", "seq", F.coalesce("jump2", "jump").alias("jump"), F.least("first", "first2").alias("first"),
            F.coalesce("ended2", "ended").alias("ended"), (~F.coalesce(F.col("first2") >= F.col("first"), F.lit(True)) | (F.coalesce("ended2", "ended") != F.col("ended"))).alias("moved"),
        )
        state = stored(doubled)
        if state.where("moved").isEmpty():
            break
    gone = drops.select("topic", F.col("id").alias("jump"), F.lit(True).alias("dropped"))
    known = state.join(gone, ["topic", "jump"], "left")
    undone = F.col("first").isNull() | (F.struct("seq", F.col("id").alias("at")) <= F.col("first"))
    stays = F.col("ended") & F.col("dropped").isNull()
    return known.select("topic", "id", F.when(stays, F.col("jump")).when(~undone, F.col("first.at")).alias("home"))


def excluded(groups: DataFrame, topics: DataFrame, off: DataFrame) -> DataFrame:
    """(topic, answer_group, note) of the groups said to be off the topic; a null note is for those that go.

    A group that names the topic in its own subject stays. If no other group names the topic, the largest of the rest stay until at most EXCLUDED_SHARE of the questions go.
    """
    sizes = groups.where(F.col("answer_group").isNotNull()).groupBy("topic", "answer_group").agg(F.min("answer").alias("answer"), F.min("category").alias("of"), F.countDistinct("question").alias("n"))
    named = names_topic(F.col("answer"), F.col("title"))
    known = stored(sizes.join(topics.where(F.col("topic").isNotNull()).dropDuplicates(["topic"]), "topic").select("topic", "answer_group", "n", named.alias("named"), (F.col("of").eqNullSafe(F.col("category"))).alias("own")))
    said = off.groupBy("topic", "answer_group").agg(F.min("seq").alias("seq"))
    judged = stored(known.join(said, ["topic", "answer_group"], "left"))
    chosen = F.col("seq").isNotNull() & ~(F.col("named") & F.col("own"))
    sums = judged.groupBy("topic").agg(F.sum("n").alias("total"), F.max(F.col("named") & ~chosen).alias("safe"))
    share = running(judged.where(chosen), "topic", [F.col("n"), F.col("seq").desc()], F.col("n"), "upto").join(sums, "topic")
    fits = F.col("safe") | (F.col("upto") <= EXCLUDED_SHARE * F.col("total"))
    goes = share.select("topic", "answer_group", F.when(~fits, "would leave under half the questions").alias("note"))
    stay = judged.where(F.col("seq").isNotNull() & F.col("named") & F.col("own")).select("topic", "answer_group", F.lit("names the topic in its own subject").alias("note"))
    unknown = said.join(known, ["topic", "answer_group"], "left_anti").join(known.select("topic").distinct(), "topic", "left_semi").select("topic", "answer_group", F.lit("unknown group").alias("note"))
    return goes.unionByName(stay).unionByName(unknown)


class Checked:
    """The edits that hold, as tables, and notes on those that don't."""

    def __init__(self, clues: DataFrame, spellings: DataFrame, sources: DataFrame, edits: DataFrame):
        ids = clues.select("topic", "id").distinct()
        known = stored(edits.join(ids, ["topic", "id"], "left_semi"))
        note = lambda rows, why: rows.select("topic", "seq", "id", F.lit(why).alias("note"))
        notes = [note(edits.join(ids, ["topic", "id"], "left_anti"), "unknown id")]

        forms = stored(spellings.where(F.col("spelling").isNotNull()).select("topic", "id", "spelling").distinct())
        named = known.select("topic", "id", "seq", F.explode(F.array_distinct("remove")).alias("spelling")).join(forms, ["topic", "id", "spelling"])
        taken = named.groupBy("topic", "id", "seq").agg(F.count("*").alias("k")).join(forms.groupBy("topic", "id").agg(F.count("*").alias("n")), ["topic", "id"]).where("k < n")
        self.removed = stored(named.join(taken.groupBy("topic", "id").agg(F.max("seq").alias("seq")), ["topic", "id", "seq"]).select("topic", "id", "spelling"))

        self.drops = stored(known.where("action = 'drop'").select("topic", "id").distinct())
        merges = known.where("action = 'merge'")
        targets = ids.select("topic", F.col("id").alias("into"), F.lit(True).alias("there"))
        aimed = stored(merges.join(targets, ["topic", "into"], "left").withColumn("good", F.col("there").isNotNull() & (F.col("into") != F.col("id"))))
        notes.append(note(aimed.where("not good"), "merge into unknown"))
        edges = stored(_last(aimed.where("good"), "into").join(self.drops, ["topic", "id"], "left_anti"))
        homes = stored(settled(edges, self.drops))
        self.merges = homes.where("home is not null")
        notes.append(note(edges.join(homes.where("home is null"), ["topic", "id"], "left_semi"), "target dropped or circular"))

        label = F.trim(F.coalesce("label", F.lit("")))
        renames = stored(known.where("action = 'rename'").select("topic", "id", "seq", label.alias("label"), F.size(F.filter(F.split(label, r"\s+"), lambda w: w != "")).alias("n")))
        wanted = renames.where(F.col("n").between(1, LABEL_WORDS)).select("topic", "id", "seq", F.explode(words(F.col("label"))).alias("word"))
        texts = sources.select("topic", "id", "text").unionByName(clues.select("topic", "id", F.col("label").alias("text")))
        texts = texts.join(renames.select("topic", "id").distinct(), ["topic", "id"], "left_semi")
        own = texts.select("topic", "id", F.explode(words(F.col("text"))).alias("have")).distinct()
        exact = wanted.join(own.withColumnRenamed("have", "word"), ["topic", "id", "word"], "left_anti")
        near = (F.length("word") >= NEW_LETTERS) & (F.length("have") >= OLD_LETTERS) & (F.abs(F.length("word") - F.length("have")) <= LETTERS_APART)
        corrected = exact.join(own, ["topic", "id"]).where(near).where(likeness("have", "word") >= WORD_LIKENESS).select("topic", "id", "seq", "word").distinct()
        foreign = exact.join(corrected, ["topic", "id", "seq", "word"], "left_anti").select("topic", "id", "seq").distinct()
        judged = stored(renames.join(foreign.withColumn("foreign", F.lit(True)), ["topic", "id", "seq"], "left"))
        short = F.col("n").between(1, LABEL_WORDS)
        notes += [note(judged.where(~short), "label empty or too long"), note(judged.where(short & F.col("foreign").isNotNull()), "label with words of its own")]
        self.renames = stored(_last(judged.where(short & F.col("foreign").isNull()), "label").select("topic", "id", F.col("label").alias("renamed")))
        self.notes = notes[0]
        for more in notes[1:]:
            self.notes = self.notes.unionByName(more)


def cleaned(clues: DataFrame, spellings: DataFrame, checked: Checked, groups: DataFrame, off: DataFrame) -> DataFrame:
    """(topic, id, label, n_questions, n_clues, n_spellings, rank_before, rank): clues that stay, by the distinct questions of all merged into them.

    `off` is (topic, answer_group, note) of `excluded`; questions of groups without a note don't count. A clue without questions left goes.
    """
    homes = clues.select("topic", "id").distinct().join(checked.drops, ["topic", "id"], "left_anti").join(checked.merges, ["topic", "id"], "left").select("topic", "id", F.coalesce("home", "id").alias("home"))
    homes = stored(homes)
    outside = groups.join(off.where("note is null").select("topic", "answer_group"), ["topic", "answer_group"], "left_semi").select("topic", "question").distinct()
    uses = spellings.where(F.col("question").isNotNull() & F.col("spelling").isNotNull()).select("topic", "id", "spelling", "question").distinct()
    left = uses.join(checked.removed, ["topic", "id", "spelling"], "left_anti").join(outside, ["topic", "question"], "left_anti").join(homes, ["topic", "id"])
    left = stored(left)
    counts = left.select("topic", "home", "question").distinct().groupBy("topic", "home").agg(F.count("*").alias("n_questions"))
    forms = left.select("topic", "home", "id", "spelling").distinct().groupBy("topic", "home").agg(F.count("*").alias("n_spellings"))
    members = homes.groupBy("topic", "home").agg(F.count("*").alias("n_clues"))
    rows = counts.join(forms, ["topic", "home"]).join(members, ["topic", "home"]).withColumnRenamed("home", "id")
    rows = rows.join(clues.select("topic", "id", "label", F.col("rank").alias("rank_before")), ["topic", "id"]).join(checked.renames, ["topic", "id"], "left")
    shown = rows.select("topic", "id", F.coalesce("renamed", "label").alias("label"), "n_questions", "n_clues", "n_spellings", "rank_before")
    return numbered(shown, "topic", [F.col("n_questions").desc(), F.col("rank_before"), F.col("id")], "rank")
