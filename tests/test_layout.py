"""Sentences, kinds and giveaways against a plain scan, on texts with every rule and the odd cases."""

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tessera.functions import sentences as S
from tessera.plans.layout import layout

CASES = [
    None, "", "   ", "(*)", "One sentence", "C. D. Orlov built this. This man left.", "She met Dr. Okafor at No. 3. The rest is known.", 'They cried "Ho! Row on, row!" Then they left. "Why? Ask." It was so.',
    "It fell “so! Far” then. He rose! And went. lower case. Still?", "First clue here (*) second one. For 10 points, name this thing.", "Note to moderator: read slowly. Clue one. Clue two. FTP, name it.",
    "A kite lost in the rain begins the second act of, for 10 points, what drama?", "; ".join(f"part {k} of a long sentence with words" for k in range(9)) + ". For ten points, identify him.",
    "Model T. This one is driven. U.K. Rail was one. In 1911. 7 more.", "Tab\tand wide. (*) (*) Two marks.", "Descriptive answer acceptable. It burned.", "x;  y; z " * 30, "Word. " * 3000,
]


def plain_rows(question):
    """Rows (sentence, part, kind, text, char_start, char_end, word_start, word_end, in_power) by walking over the words."""
    flat = " ".join((question or "").split())
    clean = re.sub(r"(?: *\(\*\) *)+", " ", flat).strip(" ")
    power = None
    if "(*)" in flat:
        before = flat.split("(*)")[0].strip(" ")
        power = len(before) + (1 if before and len(clean) > len(before) else 0)
    words = clean.split(" ") if clean else []
    found, held = [], []
    for k, word in enumerate(words):
        held.append(word)
        core = word.rstrip("\"”’')]")
        if k + 1 == len(words):
            found.append(" ".join(held))
            break
        if not core or core[-1] not in ".!?":
            continue
        after, sentence = words[k + 1], " ".join(held)
        if not (after[0].isupper() or after[0].isdigit() or after[0] in "\"“'(["):
            continue
        if word[-1] in "!?" and (sentence.count('"') % 2 or sentence.count("“") > sentence.count("”")):
            continue
        if word[-1] == ".":
            token = word.rstrip(".!?\"”’')").lower()
            lead = re.match(r"[\"“'(\[]*([\w'’]*)", after)[1].lower()
            short = (len(token) == 1 and token.isalpha()) or token.isdecimal() or re.fullmatch(r"(?:[a-z]\.)+[a-z]", token)
            if token in S.ABBREVIATIONS or (short and lead not in S.STARTERS):
                continue
        found.append(sentence)
        held = []
    notes = [s.lower().startswith(S.NOTE_OPENINGS) for s in found]
    body = [i for i, n in enumerate(notes) if not n]
    ask = [i for i in body if re.search(S.ASKS, found[i])]
    give = ask[0] if ask else body[-1] if len(body) > 1 else None
    rows, at = [], 0
    for i, s in enumerate(found):
        hit = re.search(S.ASKS, s)
        lead = re.sub("[ ,;–—-]+$", "", s[: hit.start()]).rstrip(" ") if hit else ""
        if notes[i]:
            made = [(s, "note", 0)]
        elif give is None or i < give:
            made = cut(s)
        elif hit and body == [i] and len(lead) > 25:
            made = [*cut(lead), (s[hit.start() :], "giveaway", hit.start())]
        else:
            made = [(s, "giveaway", 0)]
        for part, (t, kind, off) in enumerate(made):
            a = at + off
            first = clean.count(" ", 0, a)
            rows.append((i, part, kind, t, a, a + len(t), first, first + t.count(" ") + 1, power is not None and a < power))
        at += len(s) + 1
    return rows


def cut(s):
    if len(s.split(" ")) <= S.LONG_WORDS:
        return [(s, "clue", 0)]
    out, start = [], 0
    for m in re.finditer("; ", s):
        if m.start() + 1 - start > S.SHORT_PIECE:
            out.append((s[start : m.start() + 1], "clue", start))
            start = m.end()
    return [r for r in [*out, (s[start:], "clue", start)] if r[0].strip()]


def check(spark, texts):
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "id long, q string, `text` string")
    got = {}
    for r in layout(rows, "id", "q").collect():
        got.setdefault(r.id, []).append((r.sentence, r.part, r.kind, r.text, r.char_start, r.char_end, r.word_start, r.word_end, r.in_power))
    for k, t in enumerate(texts):
        assert sorted(got.get(k, [])) == sorted(plain_rows(t)), t


def test_cases(spark):
    check(spark, CASES)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["A.", "Dr.", "cat", "Cat", '"Oh!', 'so?"', "3.", "This", "“Ah!", "no”", "U.S.", "; ", "FTP,", "name", "it.", "(*)", "end!)", "Both answers required."]), max_size=60).map(" ".join), min_size=40, max_size=60))
def test_any(spark, texts):
    check(spark, texts)


def test_empty(spark):
    assert layout(spark.createDataFrame([], "id long, q string"), "id", "q").count() == 0


def test_facts(spark):
    told = [
        ("A kite is lost in the rain in, for 10 points, what drama?", "A kite is lost in the rain in"), ("For 10 points, name this poet.", ""), ("FTP, identify this painter of barns and rivers.", "painter of barns and rivers"),
        ("Please give the longest river of Peru.", "longest river of Peru"), ("Please give", "Please give"), ("Name me those two!", ""), ("What the river?", ""), ("FTP, please identify us them all", ""), ("For ten points--which poet?", ""), ("For ten points--who is it?", "who is it?"), ("", ""),
    ]
    got = spark.createDataFrame([(t,) for t, _ in told], "t string").select(S.giveaway_facts(F.col("t")).alias("f")).collect()
    assert [r.f for r in got] == [f for _, f in told]


def plain_terms(text):
    """Terms by walking over matches; the first spelling of each."""
    said = r"""\[[^\]]*[-"“][^\]]*\]|\(\s*["“][^)]*\)|\(\s*(?:[A-Za-z']*[A-Z]{2}[a-z]*-[A-Za-z' -]*|[A-Za-z']*-[A-Z]{2}[A-Za-z' -]*)\)"""
    t = re.sub(said, " ", text or "")
    out = []
    for m in re.finditer(r'["“]([^"”]{3,80})["”]', t):
        if not t[: m.start()].rstrip(" ").endswith("("):
            words = " ".join(re.sub(r'["“”\[\]]', "", m[1]).split(" ")).strip(" .,;:!?").split()
            if words and words[0].lower() not in S.FRAGMENTS:
                out.append(" ".join(words))
    t = re.sub(r"\[[^\]]*\]", " ", t)
    at = 0
    cap = re.compile(r"[A-Z][\w'’-]*\.?")
    while m := cap.search(t, at):
        if m.start() and re.match(r"[\w'’]", t[m.start() - 1]):
            at = m.start() + 1
            continue
        words, end = [m[0]], m.end()
        while more := re.compile(rf" +(?:({'|'.join(S.WITHIN)}) +)?([A-Z][\w'’-]*\.?)").match(t, end):
            words += [w for w in more.groups() if w]
            end = more.end()
        words[-1] = words[-1].rstrip(".")
        while words and words[0].lower() in S.NO_TERMS:
            words.pop(0)
        if words and (len(words) > 1 or m.start()):
            out.append(" ".join(words))
        at = end
    out += re.findall(r"\b[0-9][0-9,]{2,}\b", t)
    kept = {}
    for x in out:
        if len(x) > 1:
            kept.setdefault(x.lower(), x)
    return list(kept.values())


def test_long_texts_take_linear_time():
    """A megabyte of sentences, of capitalised words, of brackets: walked over in seconds."""
    for unit in ("Then it rained again. ", "Anna Berg ", "(ka-LA) [b-c] ", '"so on" ', "; and more words", "Dr. A. "):
        text = (unit * (1_000_000 // len(unit))).strip()
        began = time.process_time()
        assert list(S.split_question(text)) and isinstance(S.terms(text), list) and isinstance(S.facts(text), str)
        assert time.process_time() - began < 5, unit


def test_terms(spark, sf_dir):
    texts = [c and " ".join(c.split()) for c in CASES] + [
        'She sang "The Long Ferry" and "in Kyoto." near St. Albans, Vermont.', 'Maeve O\'Hara of the Western Isles carved 2,418 spoons in 1877.', 'Said ("KAR-uh-mel") or ["ah-ah-lite"] (VEEN-ders) or (no-WAY) by Lady [young] Marsh.',
        "This Jan van Dorp is jan VAN. Jan Van Dorp again.", "Growth in B. minor.", "A.", '"we all may call [the miller] home" ended it.', "The anti-Dorp League and Dorp-like -Marsh.",
    ]
    texts += [" ".join(r.text.split())[:3000] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    got = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", S.sentence_terms(F.col("t")).alias("x")).collect()
    for r in got:
        assert r.x == plain_terms(texts[r.k]), texts[r.k]
