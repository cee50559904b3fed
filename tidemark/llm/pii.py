"""Personal data: candidate spans, boosted trees, calibrated thresholds; within DataFrame functions.

Base spans are the matches of four formats that pass their checks (octets, Luhn, digit
counts). Loose generators propose further spans, which may overlap each other and base
spans. Gradient-boosted trees score them by format and context; a threshold per kind,
calibrated on the half of the training rows that the trees have not seen, selects
redactions. Base spans always stay; a selected span that overlaps one, or a better one
that stays, goes. So the model decides on what the base formats miss: obfuscated
addresses, national phone numbers, cards and addresses in other punctuation, and secrets.

The trees are fitted by MLlib on ``PLANTS`` generated lines whose truth is known: personal
data in the formats above, perturbed and obfuscated, and hard negatives (dates, versions,
prices, ISBNs, checksums, identifiers), with words around them that fit, mislead or say
nothing. No label comes from a base pattern or from the corpus, so the model is the same
for all inputs. Fitted trees become column expressions, and all documents are scored
within their rows, without a shuffle.

Expressions are written with possessive loops and run starts (``\\G`` or no character of
the run in front), which match the same as the plain forms but never backtrack or
recurse over long runs. Positions are sums over blocks of matches and overlaps are looked
for between neighbours in order, so the work grows with the number of matches.

Defined cases: a null text is empty; no spans give counts 0, the SHA-256 of nothing and an
empty string; repeated rows are searched each; an empty table gives an empty result;
columns named like a result are replaced, all others kept.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import best_apart, clear_of, documents, durable, let, packed, record, runs, summed_before, unpacked, whole_text

KINDS = ("email", "ip", "card", "phone", "secret")
_MAIL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DOT = r"(?: ?(?:\.|\(dot\)|\[dot\]) ?| dot )"
_WORD_DOT = r"(?: ?(?:\(dot\)|\[dot\]) ?| dot )"
GENERATORS = {
    "mail": rf"(?<!{_MAIL}){_MAIL}++(?: ?@ ?[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+| ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?:{_WORD_DOT}[A-Za-z0-9-]++)++)",
    "number": r"(?<![0-9])\+?\(?[0-9][0-9\x20()./-]{5,}[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{20,}+",
}
WORDS = {
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|contact|reach)",
    "card": r"(?i)(?:card|visa|credit|amex|account|payment)",
    "ip": r"(?i)(?:\bip\b|host|server|address|gateway|subnet)",
    "secret": r"(?i)(?:key|token|secret|password|passwd|auth|credential)",
    "digest": r"(?i)(?:commit|sha-?[0-9]*|md5|checksum|digest|revision|hash|etag|build)",
    "count": r"(?i)(?:isbn|version|release|chapter|page|price|total|order|invoice|between|from|since|score)",
}
PLANTS = 9_000
TREES, DEPTH = 12, 4
PRECISION = 0.9
SEED = 31
#: Characters in front of a candidate that its features see.
CONTEXT = 24
_PLACE = "struct<start:int,end:int,m:string,before:string,after:string>"
_SPAN = "struct<start:int,rank:int,end:int,score:double>"
RESULTS = ["base_spans", "all_spans"]


def places(text: Column, pattern: str) -> Column:
    """All matches with start and end in code points and what stands around them."""
    cut = record(p=F.split(text, pattern, -1), m=F.regexp_extract_all(text, F.lit(pattern), 0))

    def place(p: Column, m: Column, at: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            start = F.get(at, i) + F.length(F.get(p, i))
            return record(start=start, end=start + F.length(x), m=x, before=F.right(F.get(p, i), F.lit(CONTEXT)), after=F.left(F.coalesce(F.get(p, i + 1), F.lit("")), F.lit(1)))

        return F.transform(m, one)

    return let(cut, lambda c: let(summed_before(F.transform(c["m"], lambda x, i: F.length(F.get(c["p"], i)) + F.length(x))), lambda at: place(c["p"], c["m"], at)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    doubled = lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), doubled), F.lit(0), lambda s, x: s + x) % 10 == 0


def _octet(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(plain) > 3, F.lit(False)).otherwise(plain.cast("int") <= 255)


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _octet),
    "card": lambda m: F.when(F.length(_digits(m)).between(12, 19), _luhn(_digits(m))).otherwise(F.lit(False)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
#: What a text must contain for a format to be looked for.
GATES: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "mail": lambda t: t.contains("@") | t.contains("(at)") | t.contains("[at]") | (t.contains(" at ") & t.contains(" dot ")),
    "number": lambda t: t.rlike(r"[0-9][0-9\x20()./-]{5}"),
    "secret": lambda t: t.rlike("[A-Za-z0-9_/+-]{20}"),
}


def base_spans(text: Column) -> Column:
    """Checked matches of the four base formats, by start and then kind."""
    none = F.array().cast(f"array<{_SPAN}>")

    def of(kind: str) -> Column:
        kept = F.filter(places(text, BASE[kind]), lambda p: CHECKS[kind](p["m"]))
        spans = F.transform(kept, lambda p: record(start=p["start"], rank=F.lit(KINDS.index(kind)), end=p["end"], score=F.lit(1.0)))
        return F.when(GATES[kind](text), spans).otherwise(none)

    return F.array_sort(F.concat(*map(of, BASE)))


FEATURES = (
    "generator", "length", "digits", "letters", "uppers", "marks", "blanks", "groups", "longest", "plus", "dots", "disguised", "luhn", "octets", "dated", "prefix",
    "hexadecimal", "assigned", "glued_left", "glued_right", "distinct", *(f"near_{k}" for k in WORDS),
)


def _is_luhn(m: Column) -> Column:
    return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))


def _is_octets(m: Column) -> Column:
    return let(F.regexp_extract_all(m, F.lit("[0-9]+"), 0), lambda g: (F.size(g) == 4) & F.forall(g, _octet))


def features(p: Column, generator: int) -> Column:
    """Format and context of a candidate, as an array of doubles in the order of ``FEATURES``."""
    m, before = p["m"], p["before"]
    of_number = generator == 1
    values = {
        "generator": F.lit(generator),
        "length": F.length(m),
        "digits": F.length(_digits(m)),
        "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        "uppers": F.length(F.regexp_replace(m, "[^A-Z]", "")),
        "marks": F.length(F.regexp_replace(m, r"[A-Za-z0-9\x20]", "")),
        "blanks": F.length(F.regexp_replace(m, r"[^\x20]", "")),
        "groups": F.size(F.regexp_extract_all(m, F.lit("[A-Za-z0-9]+"), 0)),
        "longest": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(m, F.lit("[A-Za-z0-9]+"), 0), F.length)), F.lit(0)),
        "plus": m.startswith("+") | before.endswith("+"),
        "dots": F.length(F.regexp_replace(m, "[^.]", "")),
        "disguised": m.rlike(r"\((?:at|dot)\)|\[(?:at|dot)\]| at .* dot ") if generator == 0 else F.lit(False),
        "luhn": _is_luhn(m) if of_number else F.lit(False),
        "octets": _is_octets(m) if of_number else F.lit(False),
        "dated": m.rlike(r"(?:^|[^0-9])(?:1[0-9]|20)[0-9]{2}(?:[^0-9]|$)"),
        "prefix": m.rlike("^(?:sk|pk|rk|ghp|gho|glpat|AKIA|ASIA|AIza|xox|eyJ)"),
        "hexadecimal": m.rlike("^[0-9a-f]+$|^[0-9A-F]+$"),
        "assigned": before.rlike(r"""[=:][\x20]?["']?$"""),
        "glued_left": before.rlike(r"[\p{L}\p{N}_]$"),
        "glued_right": p["after"].rlike(r"^[\p{L}\p{N}_]"),
        "distinct": F.size(F.array_distinct(F.split(m, ""))),
        **{f"near_{k}": before.rlike(words) for k, words in WORDS.items()},
    }
    return F.array(*[values[k].cast("double") for k in FEATURES])


def _kind_rank(p: Column, generator: int) -> Column:
    """Place in ``KINDS`` of what a candidate would be."""
    if generator != 1:
        return F.lit(0 if generator == 0 else 4)
    return F.when(_is_octets(p["m"]), F.lit(1)).when(_is_luhn(p["m"]), F.lit(2)).otherwise(F.lit(3))


def candidates(text: Column) -> Column:
    """All generators' proposals with features."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int,f:array<double>>>")

    def of(g: int, name: str) -> Column:
        # What is over-long to be a number or a secret is still proposed: the trees see its length.
        return F.when(GATES[name](text), F.transform(places(text, GENERATORS[name]), lambda p: record(start=p["start"], rank=_kind_rank(p, g), end=p["end"], f=features(p, g)))).otherwise(none)

    return F.concat(*[of(g, name) for g, name in enumerate(GENERATORS)])


def tree_table(debug: str, weights: tuple[float, ...]) -> list[dict]:
    """MLlib's description of an ensemble as arrays by node: feature, limit, next node to the left and right, value."""
    lines = [x.strip() for x in debug.splitlines()]
    at = 0

    def node(tree: dict) -> int:
        nonlocal at
        line, own = lines[at], len(tree["f"])
        at += 1
        for k in tree.values():
            k.append(0)
        if m := re.match(r"Predict: (\S+)", line):
            tree["l"][own] = tree["r"][own] = own
            tree["v"][own] = float(m[1])
            return own
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        tree["f"][own], tree["t"][own] = int(m[1]), float(m[2])
        tree["l"][own] = node(tree)
        at += 1  # the line with Else
        tree["r"][own] = node(tree)
        return own

    trees = []
    while at < len(lines):
        if re.match(r"If|Predict", lines[at]):
            tree: dict[str, list] = {k: [] for k in "ftlrv"}
            node(tree)
            trees.append(tree | {"w": weights[len(trees)]})
        else:
            at += 1
    return trees


class PiiModel:
    """Fitted trees as tables, and the thresholds by kind."""

    def __init__(self, trees: list[dict] | None = None, thresholds: dict[str, float] | None = None):
        self.trees, self.thresholds = trees or [], thresholds or {}

    def scored(self, items: Column, shape: Callable[[Column, Column], Column]) -> Column:
        """``shape(item, score)`` of each item with features ``f``: every tree is walked from its root down ``DEPTH`` nodes."""
        table = F.from_json(F.lit(json.dumps(self.trees)), "array<struct<f:array<int>,t:array<double>,l:array<int>,r:array<int>,v:array<double>,w:double>>")
        steps = F.array(*map(F.lit, range(DEPTH)))

        def leaf(t: Column, f: Column) -> Column:
            return F.aggregate(steps, F.lit(0), lambda i, _: F.when(F.get(f, F.get(t["f"], i)) <= F.get(t["t"], i), F.get(t["l"], i)).otherwise(F.get(t["r"], i)))

        def score(trees: Column, f: Column) -> Column:
            return 1 / (1 + F.exp(-2 * F.aggregate(trees, F.lit(0.0), lambda acc, t: acc + t["w"] * F.get(t["v"], leaf(t, f)))))

        return let(table, lambda trees: F.transform(items, lambda x: let(score(trees, x["f"]), lambda s: shape(x, s))))


# Training rows


_NAMES = ("anna", "j.smith", "peter_k", "maria-lopez", "info", "tom99", "sales", "k.mueller", "zoe", "li.wei")
_DOMAINS = ("example", "mail-hub", "acme", "uni-town", "posteo", "shopnow", "x9net")
_ENDS = ("com", "org", "net", "de", "co", "io", "fr")
_PLAIN = ("and then the", "which", "of the old", "und die", "para los", "we saw", "it was", "dans la", "a note on", "")
_BEHIND = ("and so on", "which is", "again", "und", "de la", "in the end", "", "that day")
_FITTING = {
    0: ("mail me:", "write to", "contact", "e-mail"), 1: ("the server", "ip", "host", "gateway address"), 2: ("card", "visa", "credit card no.", "payment account"),
    3: ("call", "phone", "tel.", "mobile:", "fax"), 4: ('token = "', "api_key=", "secret:", "password: ", 'auth "', "key "),
}
_MISLEADING = ("version", "page", "order", "isbn", "between", "commit", "checksum", "md5", "price", "release", "since", "invoice")


def _card(rnd: random.Random, valid: bool = True) -> str:
    """Sixteen digits; the last one makes the Luhn sum right, or wrong."""
    body = [4, *rnd.choices(range(10), k=14)]
    doubled = [d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(body)]
    return "".join(map(str, [*body, (-sum(doubled) + (0 if valid else 3)) % 10]))


def _planted(rnd: random.Random) -> list[tuple[int, str]]:
    """Kind and text of one example of each format; -1 is no personal data, -2 a checksum."""
    name, domain, end = rnd.choice(_NAMES), rnd.choice(_DOMAINS), rnd.choice(_ENDS)
    digits = lambda n: "".join(rnd.choices("0123456789", k=n))
    hexa = lambda n: "".join(rnd.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=n))
    quads = lambda c, by: by.join(c[k : k + 4] for k in (0, 4, 8, 12))
    octets = [str(rnd.randint(1, 254)) for _ in range(4)]
    year, month, day = str(rnd.randint(1950, 2029)), f"{rnd.randint(1, 12):02d}", f"{rnd.randint(1, 28):02d}"
    return [
        (0, f"{name} (at) {domain} (dot) {end}"), (0, f"{name}[at]{domain}.{end}"), (0, f"{name} @ {domain} . {end}"), (0, f"{name} at {domain} dot {end}"), (0, f"{name}@{domain}.{end}"), (0, f"{name}(at){domain}[dot]{end}"),
        (1, "-".join(octets)), (1, " . ".join(octets)), (1, ".".join(octets)), (1, ".".join(octets) + "/24"),
        (2, quads(_card(rnd), ".")), (2, quads(_card(rnd), " - ")), (2, quads(_card(rnd), "/")), (2, quads(_card(rnd), " ")), (2, quads(_card(rnd), "  ")),
        (3, f"0{digits(3)} {digits(7)}"), (3, f"({digits(3)}) {digits(3)}-{digits(4)}"), (3, f"{digits(3)}-{digits(3)}-{digits(4)}"), (3, f"0049 {digits(2)} {digits(7)}"), (3, f"0{digits(2)}/{digits(7)}"), (3, f"+{digits(2)} {digits(3)} {digits(6)}"),
        (4, hexa(32)), (4, hexa(40)), (4, hexa(64)), (4, mixed(32)), (4, mixed(24)), (4, "sk-" + mixed(36)), (4, "ghp_" + mixed(36)), (4, "AKIA" + mixed(16).upper()), (4, "eyJ" + mixed(40)),
        (-1, f"{year}-{month}-{day}"), (-1, f"{day}.{month}.{year}"), (-1, f"{year}/{rnd.randint(1950, 2029)}"), (-1, f"{year}-{rnd.randint(1950, 2029)} {month}"), (-1, f"{day}.{month} - {rnd.randint(10, 23)}.{month}"),
        (-1, ".".join(str(rnd.randint(0, 30)) for _ in range(5))), (-1, ".".join(digits(3) for _ in range(3))), (-1, f"978-3-{digits(2)}-{digits(6)}-{digits(1)}"), (-1, f"10.{digits(4)}/{digits(5)}"), (-1, digits(14)), (-1, digits(9)),
        (-1, f"{year}-{digits(6)}"), (-1, quads(_card(rnd, False), ".")), (-1, " ".join(str(rnd.randint(1, 99)) for _ in range(6))), (-1, f"{digits(4)} {digits(4)} {digits(2)}"),
        (-1, f"{name} @ {domain}"), (-1, f"{name} at {domain}. Then"), (-1, f"meet@{domain}"), (-1, "-".join(map(hexa, (8, 4, 4, 4, 12)))), (-1, f"{domain}_of_the_{name}_part_{day}_final"),
        (-1, f"articles/{year}/how-to-write-good-words"), (-1, f"Donaudampfschiff-gesellschaft-{year}"), (-1, f"img_{year}{month}{day}_{digits(6)}_large"), (-2, hexa(40)), (-2, hexa(32)), (-2, hexa(64)),
    ]


def plants(spark: SparkSession, n: int = PLANTS, seed: int = SEED) -> DataFrame:
    """``(id, kind, whole, start, end)``: lines with one planted string each.

    Words in front fit the kind for seven of ten positives and say nothing for the others;
    those of negatives mislead or say nothing. A string of digits and letters a to f counts
    as a secret behind a fitting word only, and as a checksum behind another.
    """
    rnd = random.Random(seed)
    rows = []
    while len(rows) < n:
        for kind, text in _planted(rnd):
            bare = kind == 4 and re.fullmatch("[0-9a-f]+", text)
            if kind >= 0 and (bare or rnd.random() < 0.7):
                lead = rnd.choice(_FITTING[kind])
            else:
                lead = rnd.choice(_MISLEADING if kind == -2 or kind == -1 and rnd.random() < 0.3 else _PLAIN)
            lead = f"{rnd.choice(_PLAIN)} {lead}{'' if not lead or lead[-1] in '=\"' else ' '}"
            rows.append((len(rows), max(kind, -1), f"{lead}{text} {rnd.choice(_BEHIND)}", len(lead), len(lead) + len(text)))
    return spark.createDataFrame(rows[:n], "id long, kind int, whole string, start int, end int")


def training_rows(spark: SparkSession, n: int = PLANTS) -> DataFrame:
    """Candidates on planted lines with features, label and half; one that covers most of a positive of its kind is positive."""
    rows = plants(spark, n).select("*", F.explode(candidates(F.col("whole"))).alias("c"))
    shared = F.least("c.end", "end") - F.greatest("c.start", "start")
    spanned = F.greatest("c.end", "end") - F.least("c.start", "start")
    label = (F.col("kind") == F.col("c.rank")) & (shared >= 0.7 * spanned)
    half = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(2)) == 0
    return rows.select("c.rank", F.col("c.f").alias("f"), label.cast("double").alias("label"), half.alias("fit"))


def train(spark: SparkSession, n: int = PLANTS) -> PiiModel:
    """Trees from one half of the plants, thresholds from the other: the lowest that keep ``PRECISION`` from there on."""
    rows = durable(training_rows(spark, n).coalesce(1))
    wide = rows.where("fit").select("label", *[F.get("f", i).alias(k) for i, k in enumerate(FEATURES)])
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(wide).select("x", "label")
    fitted = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, cacheNodeIds=False).fit(assembled)
    model = PiiModel(tree_table(fitted.toDebugString, tuple(fitted.treeWeights)))
    grid = F.explode(F.array(*[F.lit(t / 20) for t in range(1, 20)])).alias("t")
    one = model.scored(F.array(record(f=F.col("f"))), lambda x, score: score)
    scored = rows.where("NOT fit").select("rank", "label", F.get(one, 0).alias("score"))
    held = scored.select("rank", "label", "score", grid).groupBy("rank", "t").agg(F.avg(F.when(F.col("score") >= F.col("t"), F.col("label"))).alias("precision")).collect()
    for rank, kind in enumerate(KINDS):
        bad = [r["t"] for r in held if r["rank"] == rank and (r["precision"] or 0.0) < PRECISION]
        good = [r["t"] for r in held if r["rank"] == rank and r["t"] > max(bad, default=0.0)]
        if good:
            model.thresholds[kind] = min(good)
    return model


def added_spans(text: Column, base: Column, model: PiiModel) -> Column:
    """Selected candidates that overlap no base span; of those that overlap the highest score stays, then the first."""
    none = F.array().cast(f"array<{_SPAN}>")
    if not model.thresholds:
        return none
    scored = model.scored(candidates(text), lambda c, score: record(start=c["start"], rank=c["rank"], end=c["end"], score=score))
    limits = F.array(*[F.lit(model.thresholds.get(k, 2.0)) for k in KINDS])
    chosen = F.array_sort(F.filter(scored, lambda c: c["score"] >= F.get(limits, c["rank"])))
    clear = let(chosen, lambda x: clear_of(x, base))
    return let(clear, lambda x: F.when(F.size(x) > 0, best_apart(x, lambda c: record(worse=-c["score"], start=c["start"], rank=c["rank"]))).otherwise(none))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """The rows with ``base_spans`` and ``all_spans``: arrays of start, kind's rank, end and score."""
    none = F.array().cast(f"array<{_SPAN}>")
    # All formats' gates as one expression; a text behind none of them has no match of any.
    whole = F.col("whole")
    signs = whole.rlike(r"@|[0-9][\x20.-]?[0-9]|\+[0-9]|[0-9][0-9\x20()./-]{5}|\(at\)|\[at\]")
    open_text = signs | (whole.contains(" at ") & whole.contains(" dot ")) | GATES["secret"](whole)
    rows = packed(docs).withColumn("whole", whole_text(F.col(f"row.`{text}`"))).withColumn("open", open_text)
    rows = rows.withColumn("base_spans", F.when(F.col("open"), base_spans(F.col("whole"))).otherwise(none))
    more = F.array_sort(F.concat("base_spans", added_spans(F.col("whole"), F.col("base_spans"), model)))
    rows = rows.withColumn("all_spans", F.when(F.col("open"), more).otherwise(none))
    return rows.select(*unpacked("row", docs.columns, RESULTS), *RESULTS)


def redact(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by its first kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(chars: Column, found: Column) -> Column:
        ends = F.transform(found, lambda r: F.array_max(F.transform(r, lambda s: s["end"])))

        def pieces(e: Column) -> Column:
            def one(r: Column, i: Column) -> Column:
                first = F.get(r, 0)
                at = F.coalesce(F.get(e, i - 1), F.lit(0))
                return F.concat(F.slice(chars, at + 1, first["start"] - at), F.array(F.get(names, first["rank"])))

            rest = F.slice(chars, F.get(e, F.size(e) - 1) + 1, F.size(chars))
            return F.array_join(F.concat(F.flatten(F.transform(found, one)), rest), "")

        return let(ends, pieces)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.split(text, ""), lambda chars: let(runs(spans), lambda found: cut(chars, found))))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find(documents(spark, sf_dir).select("doc_id", "text"), train(spark))
    ranks = F.transform("base_spans", lambda s: s["rank"])
    counts = [F.size(F.filter(ranks, lambda x: x == KINDS.index(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(span_text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("all_spans")).alias("spans"),
        (F.size("all_spans") - F.size("base_spans")).cast("long").alias("n_added"), F.size("all_spans").cast("long").alias("n_spans"),
    )
