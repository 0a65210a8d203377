"""Answer lines: 'main [accept x; or y; prompt on z; do not accept w]' as column expressions, and judging of replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import normalize

ACCEPT = r"^(?:accept|or|also accept|accept either|alternatively)\b:?\s*"
PROMPT = r"^(?:prompt on|prompt|antiprompt on|anti-prompt on)\b:?\s*"
REJECT = r"^(?:do not accept(?: or prompt on)?|don't accept|reject|not)\b:?\s*"
#: What each problem takes from the confidence.
PENALTIES = {"empty_main": 1.0, "unbalanced": 0.3, "long_main": 0.15, "unrecognised": 0.1}


def plain(line: Column) -> Column:
    """Without tags, white space single but within double quotes, where it is part of a literal."""
    pieces = F.split(F.regexp_replace(line, "<[^>]*>", ""), '"', -1)
    return F.trim(F.array_join(F.transform(pieces, lambda t, k: F.when(k % 2 == 0, F.regexp_replace(t, r"\s+", " ")).otherwise(t)), '"'))


def _literal(text: Column, otherwise: Column) -> Column:
    """What stands in double quotes if that is all of the text."""
    return F.when(text.rlike('^"[^"]*"$'), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(otherwise)


def _of(parts: Column, pattern: str) -> Column:
    """Texts of the directives of one kind, with the condition that follows 'if', 'until' or 'before'; a text in double quotes is taken as it is."""
    texts = F.transform(F.filter(parts, lambda p: p.rlike(f"(?i){pattern}")), lambda p: F.regexp_replace(p, f"(?i){pattern}", ""))
    cut = r"(?is)^(\"[^\"]*\"|.*?)(?:\s+\(?((?:if|until|before|after)\b.*?)\)?)?$"
    bare = lambda t: _literal(t, F.trim(F.regexp_replace(t, '^["“”]|["“”]$', "")))
    made = F.transform(texts, lambda t: F.struct(F.regexp_extract(t, cut, 1).alias("text"), F.nullif(F.regexp_extract(t, cut, 2), F.lit("")).alias("condition")))
    made = F.filter(made, lambda s: (bare(s["text"]) != "") | (s["text"] == '""'))
    return F.transform(made, lambda s: F.struct(bare(s["text"]).alias("text"), s["condition"].alias("condition")))


def parse(line: Column) -> Column:
    """Struct of main, required, accept, prompt, reject, issues and confidence.

    required: underlined (else bold) runs of the main answer. Null or empty lines have an empty main and confidence 0.
    """
    text = plain(F.coalesce(line, F.lit("")))
    before = F.trim(F.regexp_extract(text, r"^([^\[\(]*)", 1))
    main = _literal(before, F.trim(F.regexp_replace(before, '["“”]', "")))
    inside = F.array_join(F.regexp_extract_all(text, F.lit(r"[\[\(]([^\[\]\(\)]*+(?:\([^()]*+\)[^\[\]\(\)]*+)*+)"), F.lit(1)), ";")
    parts = F.filter(F.transform(F.split(inside, r"\s*;\s*"), lambda p: F.trim(p)), lambda p: p != "")
    known = f"(?i){ACCEPT}|{PROMPT}|{REJECT}"
    head = F.regexp_extract(F.coalesce(line, F.lit("")), r"^([^\[\(]*)", 1)
    marked = lambda tag: F.transform(F.regexp_extract_all(head, F.lit(f"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1)), lambda t: _literal(plain(t), plain(t)))
    opened = F.length(F.regexp_replace(text, r"[^\[\(]", "")) != F.length(F.regexp_replace(text, r"[^\]\)]", ""))
    tests = {"empty_main": main == "", "unbalanced": opened, "long_main": F.size(F.split(main, " ")) > 8, "unrecognised": F.exists(parts, lambda p: ~p.rlike(known))}
    issues = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda i: i.isNotNull())
    lost = sum((F.when(t, PENALTIES[k]).otherwise(0.0) for k, t in tests.items()), F.lit(0.0))
    return F.struct(
        main.alias("main"), F.when(F.size(marked("u")) > 0, marked("u")).otherwise(marked("b")).alias("required"), _of(parts, ACCEPT).alias("accept"), _of(parts, PROMPT).alias("prompt"), _of(parts, REJECT).alias("reject"),
        issues.alias("issues"), F.round(F.greatest(1.0 - lost, F.lit(0.0)), 2).alias("confidence"),
    )


def judge(given: Column, parsed: Column) -> Column:
    """'correct', 'prompt' or 'incorrect' for a reply against a parsed line: the main answer as it is written first, then exact matches, the required part, near spellings."""
    reply = normalize(given)
    names = lambda kind: F.transform(parsed[kind], lambda a: normalize(a["text"]))
    right = F.concat(F.array(normalize(parsed["main"])), names("accept"))
    near = lambda xs: F.exists(xs, lambda x: (F.length(x) >= 4) & (F.levenshtein(x, reply) * 100 <= 15 * (F.length(x) + F.length(reply)) / 2))
    held = lambda xs: F.exists(xs, lambda x: (x != "") & F.concat(F.lit(" "), reply, F.lit(" ")).contains(F.concat(F.lit(" "), x, F.lit(" "))))
    exact = lambda xs: F.array_contains(xs, reply)
    needed = F.transform(parsed["required"], normalize)
    return (
        F.when((given == parsed["main"]) & (given != ""), "correct").when(reply == "", "incorrect").when(exact(names("reject")), "incorrect").when(exact(right), "correct").when(exact(names("prompt")), "prompt")
        .when(held(F.array_except(names("reject"), right)), "incorrect").when(held(needed), "correct").when(near(F.array_except(names("reject"), right)), "incorrect").when(near(right), "correct").when(near(names("prompt")), "prompt").otherwise("incorrect")
    )
