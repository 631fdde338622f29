"""Secret scans in DataFrame functions alone.

Three rules find spans by pattern: ``assign`` (a credential word, an assignment and a value), ``access`` (key ids that
begin with AKIA) and ``hex`` (long lower-case hex runs). The randomness battery adds spans of kind ``random``: runs of
``MIN_TOKEN`` or more characters of one encoding, padding included, that mix digits and letters and meet no base span.
The encoding is inferred from the characters, each character becomes its index in that alphabet, and three tests of
uniform randomness are run on the indices: a chi-squared test over equal slices of the alphabet, a runs test about the
alphabet's middle, and lag-one serial correlation, each as a normal score.

A false discovery is a plain token (a name, a path, a counter) that is reported as random. So the null hypothesis is
the plain token: ``plain_tokens`` builds such tokens by rule from common words, digits and counters in every encoding
and length band, and the mean and spread of the three scores among them say how plain tokens of that kind and length
look. A token's scores are weighed by how far plain tokens lie from random ones in each and give the probability that
a plain token looks as random as it does. These are counted over the whole corpus in bins for each encoding and length
band, Benjamini-Hochberg at ``FDR`` decides from which bin on tokens are reported there, and of those only the ones
whose randomness the battery doesn't reject outright. The table of thresholds has one row for an encoding and a band.

Edge cases: null is the empty text and gives no spans; matches that fail a rule's length are consumed and dropped;
repeated rows each give a row; an empty table gives no rows; positions are code points, ends exclusive; a text's cost
grows with its length and its matches, not with their square; columns that aren't asked for are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.checkpoints import stored

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
MIN_TOKEN = 20
#: '=' only ends a token, as padding, so a value begins after the '=' of its name. With padding 18 characters suffice.
PAD = r"(?:={1,2}(?![A-Za-z0-9+/_=-]))"
#: Runs of one alphabet: plain or with + and /, and those with - and _. A run that mixes both gives the pieces of each.
TOKENS = (
    rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9]{{20,}}+(?![+/_-]){PAD}?|[A-Za-z0-9]{{18,19}}+{PAD})|(?<![A-Za-z0-9+/])(?=[A-Za-z0-9]*+[+/])(?:[A-Za-z0-9+/]{{20,}}+{PAD}?|[A-Za-z0-9+/]{{18,19}}+{PAD})",
    rf"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9]*+[_-])(?:[A-Za-z0-9_-]{{20,}}+{PAD}?|[A-Za-z0-9_-]{{18,19}}+{PAD})",
)
#: Letters from the commonest in plain text on, so that equal slices of an alphabet tell plain tokens from random ones.
_COMMON = "etaoinsrhldcumfpgwybvkxjqz"
#: Listed from the narrowest alphabet on; the first that holds every character is the token's encoding.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": _COMMON.upper() + "234567",
    "base36": _COMMON + "0123456789",
    "base36_upper": _COMMON.upper() + "0123456789",
    "base64": _COMMON + _COMMON.upper() + "0123456789+/",
    "base64_url": _COMMON + _COMMON.upper() + "0123456789-_",
}
BANDS = 6
BINS = 120
FDR = 0.1
#: However few tokens there are, at most so large a share of plain tokens may look as random as a reported one.
MOST_PLAIN = 0.02
#: The battery rejects randomness outright below this (of the least of three p-values, times three).
NOT_RANDOM = 0.001
#: Plain tokens of each style and band.
PLAIN = 120
KINDS = ["assign", "access", "hex", "random"]
#: Elements that are walked through in one array; longer arrays are walked block by block.
BLOCK = 256

_SPANS = "array<struct<start:int,rank:int,end:int>>"
_WORDS = (
    "the of and to in for is on that by this with you it not or be are from at as your all have new more an was we will home can us about if page my has search free but our one other do no "
    "time they site he up may what which their news out use any there see only so his when contact here business who web also now help get view online first been would how were services some"
).split()
_HEX_WORDS = ["dead", "beef", "cafe", "babe", "face", "feed", "c0de", "0000", "ffff", "1234", "2024", "0001", "00ff", "f00d", "abcd", "8000"]


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, zero: Column, step: Callable, emit: Callable, kind: str) -> Column:
    """What ``emit(state, item)`` gives for each item, the state going on by ``step(state, item)``; ``kind`` is the array's type.

    Arrays can't grow in place, so items are walked in blocks and only whole blocks are appended to the result.
    """
    none = F.array().cast(kind)

    def walk(state: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(state.alias("s"), none.alias("out")), lambda a, x: F.struct(step(a["s"], x).alias("s"), F.array_append(a["out"], emit(a["s"], x)).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))
    joined = F.aggregate(
        blocks,
        F.struct(zero.alias("s"), none.alias("out")),
        lambda a, block: _once(walk(a["s"], block), lambda w: F.struct(w["s"].alias("s"), F.concat(a["out"], w["out"]).alias("out"))),
        lambda a: a["out"],
    )
    return F.when(F.size(items) > 0, joined).otherwise(none)


def located(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as structs of start and match; split gives the text between them."""
    kind = "array<struct<start:int,m:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    steps = _once(found, lambda f: F.zip_with(f, F.slice(gaps, F.lit(1), F.size(f)), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap"))))
    walked = _once(
        steps,
        lambda t: scan(t, F.lit(0), lambda at, x: at + x["gap"] + F.length(x["m"]), lambda at, x: F.struct((at + x["gap"]).alias("start"), x["m"].alias("m")), kind),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(F.array().cast(kind))


def _as_spans(found: Column, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["m"])).alias("end")))


def _normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal: by the logistic form of Page, far out by the leading term of its expansion."""
    far = F.exp(-z * z / 2.0) / (z * 2.5066282746310002)
    return F.when(z > 4.0, far).when(z < -30.0, F.lit(1.0)).otherwise(1.0 / (1.0 + F.exp(1.5976 * z + 0.070565 * z * z * z)))


def battery(token: Column) -> Column:
    """Struct of encoding (index in ALPHABETS, null if none), band (of the length) and the scores chi, runs and serial."""
    return _once(F.regexp_replace(token, "=+$", ""), lambda body: _once(_encoding(body), lambda encoding: _battery(body, encoding)))


def _encoding(body: Column) -> Column:
    return F.coalesce(*(F.when(F.length(F.translate(body, a, "")) == 0, F.lit(i)) for i, a in enumerate(ALPHABETS.values())))


def _battery(body: Column, encoding: Column) -> Column:
    letters = F.element_at(F.array(*map(F.lit, ALPHABETS.values())), encoding + 1)
    size = F.length(letters)
    n = F.length(body)
    # Characters by one split, not by place: places in a text of several bytes a character are sought from its start.
    values = F.transform(F.split(body, "(?!^)(?!$)", -1), lambda x: F.position(x, letters) - 1)
    slices = F.greatest(F.lit(2), F.least(size, F.floor(n / 5).cast("int")))
    scores = _once(F.struct(values.alias("v"), size.alias("a"), n.alias("n"), slices.alias("k")), lambda t: _scores(t["v"], t["a"], t["n"], t["k"]))
    band = F.least(F.lit(BANDS - 1), F.floor(F.log2(n / F.lit(float(MIN_TOKEN))) * 2).cast("int"))
    return _once(scores, lambda s: F.struct(encoding.alias("encoding"), F.greatest(F.lit(0), band).alias("band"), s["chi"].alias("chi"), s["runs"].alias("runs"), s["serial"].alias("serial")))


def _scores(v: Column, a: Column, n: Column, k: Column) -> Column:
    zero = F.lit(0.0)
    expected = n / k
    chi = F.aggregate(
        F.transform(F.sequence(F.lit(0), k - 1), lambda s: F.size(F.filter(v, lambda x: F.floor(x * k / a) == s))), zero, lambda t, o: t + (o - expected) * (o - expected) / expected
    )
    spread = 2.0 / (9.0 * (k - 1))
    z_chi = (F.pow(chi / (k - 1), F.lit(1.0 / 3.0)) - (1.0 - spread)) / F.sqrt(spread)
    up = F.transform(v, lambda x: x * 2 >= a)
    n1 = F.size(F.filter(up, lambda x: x))
    n2 = n - n1
    changes = F.size(F.filter(F.zip_with(F.slice(up, F.lit(1), n - 1), F.slice(up, F.lit(2), n - 1), lambda x, y: x != y), lambda x: x))
    mean = 2.0 * n1 * n2 / n + 1.0
    var = (mean - 1.0) * (mean - 2.0) / (n - 1)
    z_runs = F.when(var > 0, (changes + 1.0 - mean) / F.sqrt(var)).otherwise(F.lit(40.0))
    middle = (a - 1) / 2.0
    centred = F.transform(v, lambda x: x - middle)
    products = F.aggregate(F.zip_with(F.slice(centred, F.lit(1), n - 1), F.slice(centred, F.lit(2), n - 1), lambda x, y: x * y), zero, lambda t, x: t + x)
    z_serial = products / (F.sqrt(n - 1.0) * (a * a - 1) / 12.0)
    return F.struct(z_chi.alias("chi"), z_runs.alias("runs"), z_serial.alias("serial"))


def plain_tokens(spark: SparkSession, each: int = PLAIN) -> DataFrame:
    """Tokens as names, paths and counters have them, by rule: ``each`` of every style and length band, column token."""
    styles = 8
    rows = spark.range(0, each * styles * BANDS, 1, 6).select("id", (F.col("id") % styles).alias("style"), F.floor(F.col("id") / styles).alias("draw"))
    pick = lambda words, j, salt: F.element_at(F.array(*map(F.lit, words)), F.pmod(F.xxhash64("id", j, F.lit(salt)), F.lit(len(words))).cast("int") + 1)
    number = lambda j: F.pmod(F.xxhash64("id", j, F.lit("number")), F.lit(10_000)).cast("string")
    some = F.transform(F.sequence(F.lit(0), F.lit(60)), lambda j: pick(_WORDS, j, "word"))
    # A number stands behind about every third word.
    dotted = lambda words, low: F.transform(words, lambda w, j: F.concat(w, F.when(F.pmod(F.xxhash64("id", j), F.lit(3)) == 0, low(j)).otherwise("")))
    with_numbers = dotted(some, number)
    to_seven = dotted(some, lambda j: F.translate(number(j), "0189", "2367"))
    hexed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda j: F.when(F.pmod(F.xxhash64("id", j), F.lit(3)) == 0, F.lpad(number(j), 6, "0")).otherwise(pick(_HEX_WORDS, j, "hex"))), "")
    camel = F.array_join(F.transform(with_numbers, lambda w: F.initcap(w)), "")
    text = (
        F.when(F.col("style") == 0, hexed)
        .when(F.col("style") == 1, F.upper(hexed))
        .when(F.col("style") == 2, F.upper(F.array_join(to_seven, "")))
        .when(F.col("style") == 3, F.array_join(with_numbers, ""))
        .when(F.col("style") == 4, F.upper(F.array_join(with_numbers, "")))
        .when(F.col("style") == 5, camel)
        .when(F.col("style") == 6, F.array_join(with_numbers, "/"))
        .otherwise(F.when(F.col("draw") % 2 == 0, F.array_join(with_numbers, "_")).otherwise(F.array_join(with_numbers, "-")))
    )
    # Lengths over the band's width; the last band goes on to twice its least length.
    low = F.lit(float(MIN_TOKEN)) * F.pow(F.lit(2.0), (F.col("draw") % BANDS) / 2.0)
    high = F.when(F.col("draw") % BANDS == BANDS - 1, low * 2.0).otherwise(low * 2.0**0.5)
    length = F.ceil(low + (high - low) * F.pmod(F.xxhash64("id", F.lit("length")), F.lit(1000)) / 1000.0).cast("int")
    return rows.select(F.substr(text, F.lit(1), length).alias("token")).where(F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]"))


def plain_looks(spark: SparkSession, each: int = PLAIN) -> dict[tuple[int, int], list[float]]:
    """For each (encoding, band) mean and spread of chi, runs and serial among plain tokens, in this order."""
    b = plain_tokens(spark, each).select(battery(F.col("token")).alias("b")).where("b.encoding IS NOT NULL").select("b.*")
    measures = [f(c).alias(f"{f.__name__}_{c}") for c in ("chi", "runs", "serial") for f in (F.avg, F.stddev)]
    rows = b.groupBy("encoding", "band").agg(*measures, F.count(F.lit(1)).alias("n")).where("n >= 10").collect()  # one row a cell
    return {(r["encoding"], r["band"]): [float(r[i]) for i in range(2, 8)] for r in rows}


def _looks_plain(t: Column, looks: dict[tuple[int, int], list[float]]) -> Column:
    """Bin of the probability that a plain token looks as random: 0 for 1, 10 for a tenth; -1 if the battery rejects randomness."""
    if not looks:
        return F.lit(-1)
    cell = F.element_at(F.create_map(*(x for (e, b), v in sorted(looks.items()) for x in (F.lit(e * BANDS + b), F.array(*map(F.lit, v))))), t["encoding"] * BANDS + t["band"])

    def weighed(c: Column) -> Column:
        # Chi is large for plain tokens; runs and serial count by the side on which plain tokens lie.
        z = [t["chi"], t["runs"], t["serial"]]
        spread = [F.greatest(c[2 * i + 1], F.lit(0.5)) for i in range(3)]
        weight = [c[2 * i] / (spread[i] * spread[i]) for i in range(3)]
        weight[0] = F.greatest(weight[0], F.lit(0.0))
        far = sum(weight[i] * (c[2 * i] - z[i]) for i in range(3))
        width = F.sqrt(sum(weight[i] * weight[i] * spread[i] * spread[i] for i in range(3)))
        return F.when(width > 0, _normal_tail(far / width)).otherwise(1.0)

    two_sided = lambda z: 2.0 * _normal_tail(F.abs(z))
    random = 3.0 * F.least(_normal_tail(t["chi"]), two_sided(t["runs"]), two_sided(t["serial"])) >= NOT_RANDOM
    depth = F.least(F.lit(BINS - 1), F.floor(-F.log10(F.greatest(_once(cell, weighed), F.lit(1e-300))) * 10).cast("int"))
    return F.when(random & cell.isNotNull(), F.greatest(F.lit(0), depth)).otherwise(-1)


def _tokens(text: Column) -> Column:
    """Tokens that mix digits and letters: start, end and match."""
    mixed = F.filter(F.concat(*(located(text, pattern) for pattern in TOKENS)), lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
    return F.transform(mixed, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), x["m"].alias("m")))


def _clear_of(found: Column, base: Column) -> Column:
    """The structs (start, end, ...) of ``found`` that meet no span of ``base``, by one walk each way over both in order."""
    kind = "array<struct<start:int,end:int,i:int>>"
    marks = F.concat(F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(-1).alias("i"))), F.transform(found, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("i"))))

    def clear(ordered: Column) -> Column:
        ends = scan(ordered, F.lit(0), lambda s, x: F.when(x["i"] < 0, F.greatest(s, x["end"])).otherwise(s), lambda s, x: F.when(s > x["start"], F.lit(-1)).otherwise(x["i"]), "array<int>")
        back = scan(F.reverse(ordered), F.lit(2147483647), lambda s, x: F.when(x["i"] < 0, F.least(s, x["start"])).otherwise(s), lambda s, x: F.when(s < x["end"], F.lit(-1)).otherwise(x["i"]), "array<int>")
        return F.filter(F.array_intersect(ends, back), lambda i: i >= 0)

    kept = _once(F.array_sort(marks.cast(kind)), clear)
    return F.when((F.size(found) == 0) | (F.size(base) == 0), found).otherwise(F.transform(kept, lambda i: F.get(found, i)))


def cuts(counts: dict[int, dict[int, int]], fdr: float) -> dict[int, int]:
    """For each cell (encoding and band) the bin from which tokens are reported: the lowest with tail probability * tokens <= fdr * reported and within MOST_PLAIN."""
    out = {}
    for cell, bins in counts.items():
        total, reported, cut = sum(bins.values()), 0, BINS
        for b in sorted((b for b in bins if b >= 0), reverse=True):
            reported += bins[b]
            if 10 ** (-b / 10) <= min(MOST_PLAIN, fdr * reported / total):
                cut = b
        out[cell] = cut
    return out


def secret_spans(docs: DataFrame, *keep: str, fdr: float = FDR) -> DataFrame:
    """The ``keep`` columns (all but the text, if none is named) with ``base`` and ``spans``: sorted arrays of (start, rank in KINDS, end).

    Texts are read once: spans and tokens with their bins, some bytes each, are stored in the shared folder; thresholds
    are counted over them.
    """
    keep = keep or tuple(c for c in docs.columns if c not in ("text", "base", "spans"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    long_value = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6
    base = F.array_sort(
        F.concat(
            _as_spans(F.filter(located(text, ASSIGN), long_value), 0),
            _as_spans(F.filter(located(text, ACCESS), lambda x: F.length(x["m"]) >= 20), 1),
            _as_spans(located(text, HEX), 2),
        )
    )
    looks = plain_looks(docs.sparkSession)
    tested = F.transform(
        F.filter(F.transform(_tokens(text), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(x["m"]).alias("t"))), lambda x: x["t"]["encoding"].isNotNull()),
        lambda x: F.struct(x["start"], x["end"], (x["t"]["encoding"] * BANDS + x["t"]["band"]).alias("cell"), _looks_plain(x["t"], looks).alias("bin")),
    )
    names = [f"keep_{i}" for i in range(len(keep))]
    found = stored(docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), base.alias("base"), tested.alias("tested")))
    counts: dict[int, dict[int, int]] = {}
    for r in found.select(F.explode("tested").alias("x")).groupBy("x.cell", "x.bin").count().collect():  # at most len(ALPHABETS) * BANDS * (BINS + 1) rows
        counts.setdefault(r["cell"], {})[r["bin"]] = r["count"]
    limits = cuts(counts, fdr)
    reported = F.array().cast("array<struct<start:int,end:int>>")
    if limits:
        at = F.create_map(*(F.lit(x) for pair in sorted(limits.items()) for x in pair))
        reported = F.transform(F.filter("tested", lambda x: x["bin"] >= at[x["cell"]]), lambda x: F.struct(x["start"], x["end"]))
    added = F.transform(_clear_of(reported, F.col("base")), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("rank"), x["end"].alias("end")))
    spans = F.array_sort(F.array_distinct(F.concat("base", added)).cast(_SPANS))
    return found.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "base", spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["rank"] == rank)).cast("long")
