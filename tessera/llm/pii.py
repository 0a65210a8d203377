"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the matches of four base shapes (always kept if valid) and of wider shapes: phone
numbers without a country code, identity numbers, account numbers, names behind a title, spelled-out
addresses. Six labelers vote on each candidate (1 personal, -1 not, 0 no opinion): shape, validity,
gazetteer, context before, context around, dummy values. Votes are counted per pattern over all
documents, with the size, the shape and a hash of the word before, which no labeler looks at: a table whose size is
bounded by the numbers of kinds, vote patterns and these. On it,
expectation-maximisation estimates every labeler's reliability without labels, and the posteriors
train the span classifier, a logistic regression whose weights become a column expression. Wider
candidates that it gives 0.5 or more and that touch no base span are added.

Offsets are code points, ends exclusive. Regexes are written to run in linear time and without
recursion: separators within a shape are first replaced by a private mark of the same length.

Defined results: null and empty texts have no spans; repeated rows count and are searched each; with no
candidate at all nothing is added; other columns stay, a column with the name of a result is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import set_apart

BASE_KINDS = ("email", "ip", "card", "phone")
WIDE_KINDS = ("tel", "id", "account", "name", "address")
KINDS = BASE_KINDS + WIDE_KINDS
#: Stands for a separator inside a shape; where a text has it itself, a character of no shape is searched instead.
MARK = "\uf8ff"
EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+{MARK}-]))[A-Za-z0-9._%+{MARK}-]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"(?<![0-9{MARK}])[0-9{MARK}]{{12,37}}+(?![0-9{MARK}])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WIDE = "|".join(
    [
        r"(?<![0-9A-Za-z+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? \p{Lu}\p{L}{1,30}(?: \p{Lu}\p{L}{1,30}){0,2}",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{2,63}){1,3}",
    ]
)
#: A few characters that any match of WIDE holds: only such texts are searched.
WIDE_HINT = r"[0-9]{3}\)?[ .-][0-9]{2}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]|(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? |[\[(]dot[\])]"

# Fixed values, gazetteers: top-level domains, calling codes, first digits of card issuers, account countries, given names.
DOMAINS = (
    "com|org|net|edu|gov|mil|int|info|biz|name|pro|coop|museum|io|ai|co|app|dev|tv|me|cc|ly|xyz|online|site|shop|store|blog|cloud|tech|email|example|test|"
    "de|fr|es|it|uk|nl|ch|at|be|eu|us|ca|br|mx|pl|se|no|fi|dk|pt|jp|cn|in|au|nz|za|ru|ua|cz|sk|hu|ro|bg|gr|tr|ie|is|lu|li|ee|lv|lt|hr|si|rs|kr|tw|hk|sg|"
    "my|th|vn|id|ph|pk|il|ae|sa|eg|ma|tn|ng|ke|ar|cl|pe|ve|uy|ec|bo|py|cr|cu|do|gt|hn|ni|pa|sv|cat|gal|bzh|eus"
)
CALLING = (
    "1|7|2[07]|21[12368]|2[2-6][0-9]|29[01789]|3[0-469]|35[0-9]|37[0-8]|38[0-3579]|4[013-9]|42[013]|5[1-8]|50[0-9]|59[0-9]|6[0-6]|67[02-9]|68[0-35-9]|69[0-2]|"
    "800|808|8[1246]|85[02356]|87[08]|88[0-368]|9[0-58]|96[0-8]|97[0-79]|99[2-689]"
)
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|65|35"
COUNTRIES = (
    "AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|BY|CH|CR|CY|CZ|DE|DK|DO|EE|EG|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IQ|IS|IT|JO|KW|KZ|LB|LC|LI|LT|LU|LV|LY|MC|MD|ME|MK|"
    "MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SC|SE|SI|SK|SM|ST|SV|TL|TN|TR|UA|VA|VG|XK"
)
NAMES = (
    "Adam|Adrian|Agnes|Alain|Albert|Alejandro|Alexander|Alice|Alicia|Amélie|Amy|Ana|Andrea|Andreas|Andrew|Angela|Anita|Ann|Anna|Anne|Antoine|Antonio|Arthur|Barbara|"
    "Beatriz|Ben|Benjamin|Bernard|Bernd|Birgit|Brian|Brigitte|Bruno|Camille|Carl|Carlos|Carmen|Carol|Caroline|Catherine|Cécile|Charles|Charlotte|Chloé|Christian|"
    "Christine|Christopher|Claire|Clara|Claude|Claudia|Cristina|Daniel|Daniela|David|Diana|Diego|Dieter|Dominique|Edward|Elena|Elisabeth|Elizabeth|Emily|Emma|Eric|"
    "Ernst|Eva|Fernando|François|Françoise|Frank|Franz|Friedrich|Gabriel|Georg|George|Gerhard|Gisela|Grace|Günter|Hannah|Hans|Heike|Heinz|Helen|Helga|Henri|Henry|"
    "Hugo|Ingrid|Isabel|Isabelle|Jack|Jacques|James|Jan|Jane|Javier|Jean|Jennifer|Jessica|Joachim|Johann|John|Jorge|José|Joseph|Juan|Julia|Julie|Jürgen|Karen|Karin|"
    "Karl|Katharina|Kevin|Klaus|Laura|Léa|Lena|Linda|Lisa|Louis|Luc|Lucas|Lucía|Luis|Manfred|Manuel|Marc|Margaret|Maria|María|Marie|Mark|Markus|Martin|Mary|Matthew|"
    "Michael|Michel|Miguel|Monika|Nancy|Nicolas|Olivier|Pablo|Patricia|Patrick|Paul|Paula|Pedro|Peter|Philippe|Pierre|Rafael|Rebecca|Renate|Richard|Robert|Rosa|Sabine|"
    "Sandra|Sarah|Sofía|Sophie|Stefan|Susan|Susanne|Sylvie|Thomas|Ursula|Uwe|Werner|William|Wolfgang"
)
BEFORE_YES = r"(?i)(?:phone|tel|call|mobile|cell|fax|contact|mail|e-mail|write|reach|card|visa|credit|debit|ssn|social|security|passport|iban|account|konto|name|dear|cher|liebe[rs]?|estimad[oa]|regards|from|ip|host|address|adresse|teléfono|tarjeta|carte)[^\p{L}]{0,6}(?:\p{L}{1,12}[^\p{L}]{1,3})?$"
BEFORE_NO = r"(?i)(?:version|ver|release|isbn|issn|page|pages|figure|fig|table|section|chapter|no|nr|order|invoice|part|serial|model|doi|pp|vol|#|\$|€|£|=)[^\p{L}]{0,3}$"

LABELERS = ("shape", "valid", "gazetteer", "before", "around", "dummy")
ROUNDS = 40
WIDTH = 32
#: Hashes of words before a candidate; one more stands for none.
WORDS = 16
CLUES = {"shape": 12, "word": WORDS + 1}


def _matches(text: Column, pattern: str, gate: Column) -> tuple[Column, Column]:
    """Matches of a pattern, and what lies between them."""
    none = F.array().cast("array<string>")
    return F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(gate, F.split(text, pattern, -1)).otherwise(none)


def _placed(matches: str, gaps: str) -> Column:
    """(start, end) of each match."""
    kind = "struct<at:bigint,k:int,out:array<struct<start:bigint,end:bigint>>>"
    begin = F.struct(F.coalesce(F.length(F.get(gaps, F.lit(0))), F.lit(0)).cast("long").alias("at"), F.lit(1).alias("k"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out")).cast(kind)

    def step(acc: Column, m: Column) -> Column:
        end = acc["at"] + F.length(m)
        span = F.struct(acc["at"].alias("start"), end.alias("end"))
        return F.struct((end + F.length(F.get(F.col(gaps), acc["k"]))).alias("at"), (acc["k"] + 1).alias("k"), F.concat(acc["out"], F.array(span)).alias("out")).cast(kind)

    return F.aggregate(F.col(matches), begin, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    places = F.filter(F.split(F.reverse(_digits(value)), ""), lambda d: d != "")
    doubled = F.transform(places, lambda d, k: F.when(k % 2 == 0, d.cast("int")).when(d.cast("int") < 5, d.cast("int") * 2).otherwise(d.cast("int") * 2 - 9))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _ip_parts(value: Column) -> Column:
    short = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with _c: all candidates as (kind, start, end, value, base), base ones first."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    out = docs.withColumn("_t", text)
    t = F.col("_t")
    clean = F.translate(t, MARK, "\ufffe")
    masked = {
        "email": (F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK), EMAIL, t.contains("@")),
        "ip": (t, IP, t.rlike(r"[0-9]\.[0-9]")),
        "card": (F.regexp_replace(clean, r"(?<=[0-9])[ -](?=[0-9])", MARK), CARD, t.rlike(r"[0-9][0-9 -]{10}")),
        "phone": (t, PHONE, t.contains("+")),
        "wide": (t, WIDE, t.rlike(WIDE_HINT)),
    }
    # texts to search first, so that no regex is written into two expressions
    out = out.withColumns({f"_s_{k}": F.when(gate, searched).otherwise("") for k, (searched, _, gate) in masked.items()})
    for part in (0, 1):
        out = out.withColumns({f"_{'mg'[part]}_{k}": _matches(F.col(f"_s_{k}"), pattern, F.col(f"_s_{k}") != "")[part] for k, (_, pattern, _) in masked.items()})
    out = out.withColumns({f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, _placed(f"_m_{k}", f"_g_{k}")).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")) for k in masked})

    def spans(kind: str) -> Column:
        value = lambda s: F.substr(t, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        if kind == "wide":
            named = lambda v: F.when(v.rlike(r"^[0-9]{3}-[0-9]{2}-"), "id").when(v.rlike(r"[\[(]at[\])]"), "address").when(v.rlike(r"^\(?[0-9]"), "tel").when(v.rlike(r"^[A-Z]{2}[0-9]{2}"), "account").otherwise("name")
        else:
            named = lambda v: F.lit(kind)
        made = F.transform(f"_p_{kind}", lambda s: F.struct(named(value(s)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value(s).alias("value"), F.lit(kind != "wide").alias("base")))
        n = lambda s: F.length(_digits(s["value"]))
        test = {
            "ip": lambda s: _ip_parts(s["value"]),
            "card": lambda s: n(s).between(12, 19) & luhn(s["value"]),
            "phone": lambda s: n(s).between(9, 15),
        }.get(kind)
        return F.filter(made, test) if test else made

    kept = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*kept, "_t", F.concat(*[spans(k) for k in (*BASE_KINDS, "wide")]).alias("_c"))


def votes(c: Column, t: Column) -> dict[str, Column]:
    """Votes of the labelers on a candidate c of the text t."""
    value, kind = c["value"], c["kind"]
    start, end = c["start"].cast("int"), c["end"].cast("int")
    before = F.substr(t, F.greatest(start - WIDTH + 1, F.lit(1)), F.least(start, F.lit(WIDTH)))
    left, right = F.substr(t, F.greatest(start, F.lit(1)), F.when(start > 0, 1).otherwise(0)), F.substr(t, end + 1, F.lit(1))
    digits = _digits(value)
    when = F.when
    return {
        "shape": when(c["base"], 1).when(kind.isin("id", "account"), 0).otherwise(when(value.rlike(r"^\([0-9]{3}\)|[\[(]dot[\])]|\. "), 1).otherwise(0)),
        "valid": when(kind == "id", when(value.rlike(r"^(?:000|666|9)|-00-|-0000$"), -1).otherwise(1))
        .when(kind == "account", when(F.length(F.regexp_replace(value, " ", "")).between(15, 34), 1).otherwise(-1))
        .when(kind == "tel", when(digits.rlike("^[2-9][0-9]{2}[2-9]"), 1).otherwise(-1))
        .when(kind.isin("card", "ip", "phone"), 1)
        .otherwise(0),
        "gazetteer": when(kind.isin("email", "address"), when(value.rlike(rf"(?i)(?:\.|[\])] ?)(?:{DOMAINS})$"), 1).otherwise(-1))
        .when(kind == "phone", when(digits.rlike(f"^(?:{CALLING})"), 1).otherwise(-1))
        .when(kind == "card", when(digits.rlike(f"^(?:{ISSUERS})"), 1).otherwise(-1))
        .when(kind == "account", when(value.rlike(f"^(?:{COUNTRIES})"), 1).otherwise(-1))
        .when(kind == "name", when(value.rlike(rf" (?:{NAMES})(?: |$)"), 1).otherwise(0))
        .otherwise(0),
        "before": when(before.rlike(BEFORE_YES), 1).when(before.rlike(BEFORE_NO), -1).otherwise(0),
        "around": when(left.rlike(r"[\p{L}\p{N}_/=.-]") | right.rlike(r"[\p{L}\p{N}_/=-]"), -1).otherwise(1),
        "dummy": when(digits.rlike(r"^(\d)\1{6,}$|1234567|0000000") | value.rlike(r"^(?:127|0|255|192\.168|10)\."), -1).otherwise(0),
    }


def _pattern(c: Column, t: Column) -> Column:
    """kind, votes and size of a candidate as one short string, the cell in which it is counted."""
    size = F.least(F.floor((c["end"] - c["start"]) / 8), F.lit(4)).cast("string")
    return F.concat_ws(",", c["kind"], *[v.cast("string") for v in votes(c, t).values()], size, *[v.cast("string") for v in clues(c, t).values()])


def clues(c: Column, t: Column) -> dict[str, Column]:
    """What the classifier sees and no labeler does: the shape of the value, and a hash of the word before it."""
    start, value = c["start"].cast("int"), c["value"]
    before = F.substr(t, F.greatest(start - WIDTH + 1, F.lit(1)), F.least(start, F.lit(WIDTH)))
    word = F.lower(F.regexp_extract(before, r"(\p{L}+)[^\p{L}]*$", 1))
    return {
        "shape": F.least(F.size(F.split(value, r"[ ().-]+")), F.lit(5)) * 2 + F.when(value.rlike("[0-9]"), 1).otherwise(0),
        "word": F.when(word == "", WORDS).otherwise(F.pmod(F.hash(word), F.lit(WORDS))),
    }


#: Kind, votes, size and clues of candidates.
Cell = tuple


def read_cell(pattern: str) -> Cell:
    kind, *rest = pattern.split(",")
    n = len(LABELERS)
    return kind, tuple(map(int, rest[:n])), *map(int, rest[n:])


def expectation_maximisation(cells: dict[Cell, int], rounds: int = ROUNDS) -> tuple[dict[Cell, float], list[dict]]:
    """Posterior of "personal" for each cell, and each labeler's vote probabilities by class.

    Labelers are taken as independent given the class; each kind has its own share of personal data. A labeler that says nothing counts
    for neither class: many say nothing of whole kinds, which would otherwise tell against these.
    Reliabilities start at better than chance, which settles which class is which.
    """
    tables = [{y: {v: 0.75 if v == (1 if y else -1) else 0.25 for v in (-1, 1)} for y in (0, 1)} for _ in LABELERS]
    share = {c[0]: 0.5 for c in cells}
    posterior: dict[Cell, float] = {}
    for _ in range(rounds):
        for cell in cells:
            kind, vote = cell[:2]
            odds = math.log(share[kind] / (1 - share[kind])) + sum(math.log(tables[j][1][v] / tables[j][0][v]) for j, v in enumerate(vote) if v)
            posterior[cell] = 1 / (1 + math.exp(-max(-35.0, min(35.0, odds))))
        for kind in share:
            n = sum(m for c, m in cells.items() if c[0] == kind)
            share[kind] = (1 + sum(m * posterior[c] for c, m in cells.items() if c[0] == kind)) / (2 + n)
        for j in range(len(LABELERS)):
            for y in (0, 1):
                weight = {v: 1.0 + (1.0 if v == (1 if y else -1) else 0.0) for v in (-1, 1)}
                for c, m in cells.items():
                    if c[1][j]:
                        weight[c[1][j]] += m * (posterior[c] if y else 1 - posterior[c])
                total = sum(weight.values())
                tables[j][y] = {v: w / total for v, w in weight.items()}
    return posterior, tables


def train_classifier(cells: dict[Cell, int], posterior: dict[Cell, float], steps: int = 200, rate: float = 0.5, decay: float = 1e-3) -> dict[tuple, float]:
    """Weights of a logistic regression on kind, votes, size and clues, fitted to the posteriors; cells count by the root of their rows."""
    of = lambda c: [("bias",), ("kind", c[0]), ("size", c[2]), *(("vote", j, v) for j, v in enumerate(c[1]) if v), *zip(CLUES, c[3:], strict=False)]
    weights: dict[tuple, float] = {}
    total = sum(math.sqrt(m) for m in cells.values()) or 1.0
    for _ in range(steps):
        slope: dict[tuple, float] = {}
        for c, m in cells.items():
            x = of(c)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(weights.get(f, 0.0) for f in x)))))
            for f in x:
                slope[f] = slope.get(f, 0.0) + math.sqrt(m) * (p - posterior[c]) / total
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) - rate * (g + decay * weights.get(f, 0.0))
    return weights


def _probability(c: Column, t: Column, weights: dict[tuple, float]) -> Column:
    total = F.lit(weights.get(("bias",), 0.0))
    for kind in WIDE_KINDS:
        total = total + F.when(c["kind"] == kind, weights.get(("kind", kind), 0.0)).otherwise(0.0)
    size = F.least(F.floor((c["end"] - c["start"]) / 8), F.lit(4))
    for s in range(5):
        total = total + F.when(size == s, weights.get(("size", s), 0.0)).otherwise(0.0)
    for j, vote in enumerate(votes(c, t).values()):
        total = total + F.when(vote == 1, weights.get(("vote", j, 1), 0.0)).when(vote == -1, weights.get(("vote", j, -1), 0.0)).otherwise(0.0)
    for name, clue in clues(c, t).items():
        total = total + F.get(F.array(*[F.lit(weights.get((name, v), 0.0)) for v in range(CLUES[name])]), clue)
    return 1 / (1 + F.exp(-total))


def count_patterns(docs: DataFrame, text_col: str = "text") -> dict[Cell, int]:
    """How many candidates each pattern has, over all documents; at most kinds x 3**6 x 5 x 12 x 17 patterns, of which few occur."""
    found = candidates(docs.select(F.col(f"`{text_col}`").alias("text")))
    patterns = found.where(F.size("_c") > 0).select(F.explode(F.transform("_c", lambda c: _pattern(c, F.col("_t")))).alias("pattern"))
    return {read_cell(r.pattern): r.n for r in patterns.groupBy("pattern").agg(F.count("*").alias("n")).collect()}


def annotate(docs: DataFrame, text_col: str = "text", cells: dict[Cell, int] | None = None) -> DataFrame:
    """The documents with base and found: arrays of (kind, start, end, value)."""
    cells = count_patterns(docs, text_col) if cells is None else cells
    posterior, _ = expectation_maximisation(cells)
    weights = train_classifier(cells, posterior)
    apart, kept, text = set_apart(docs, text_col, ("base", "found"))
    with_all = candidates(apart.withColumn("text", text)).drop("text")
    bare = lambda c: F.struct(*[c[n].alias(n) for n in ("kind", "start", "end", "value")])
    split = with_all.withColumns({"base": F.transform(F.filter("_c", lambda c: c["base"]), bare), "_w": F.filter("_c", lambda c: ~c["base"])})
    clear = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    found = F.filter(F.filter("_w", clear), lambda c: _probability(c, F.col("_t"), weights) >= 0.5)
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    return split.select(*kept, "base", F.when(F.size("_w") > 0, F.transform(found, bare)).otherwise(empty).alias("found"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every found span replaced by its kind in brackets; the columns are those of the input."""
    apart, kept, t = set_apart(docs, text_col, ())
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    marked = annotate(apart, f"c{at}")
    kind = "struct<at:bigint,out:string>"
    piece = lambda a, b: F.substr(t, (a + 1).cast("int"), (b - a).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.concat(acc["out"], piece(acc["at"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, out).otherwise(acc["out"]).alias("out")).cast(kind)

    spans = F.array_sort(F.transform(F.concat("base", "found"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")).cast(kind)
    done = F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(t).cast("long"))))
    kept[at] = F.when(F.size(F.concat("base", "found")) > 0, done).otherwise(F.col(f"c{at}")).alias(docs.columns[at])
    return marked.select(*kept)
