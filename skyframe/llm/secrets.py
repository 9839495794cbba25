"""Secrets in texts: patterns that name them, and strings that are random.

A pattern finds what looks like a key or is assigned to a password. Besides, every long run of
letters, digits and signs is given the encoding that its characters fit, and tested for being
random in it: whether its symbols are equally frequent (chi-squared), whether high and low ones
alternate as by chance (runs), and whether each is independent of the one before (serial
correlation). Strings of words fail these tests; encoded random bytes pass them.

How far a string may fail is decided for each encoding and length, since short strings fail less
clearly. The p-values of random strings are spread evenly and those of others lie near zero, so
the number above one half tells how many are random (Storey, 2002), and the least p-value is taken
above which at most a share of the strings are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.llm.tables import scratch, stored

# Pattern and group whose length counts, and the least length, by kind in order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Greedy runs: one of enough characters is found whole, and a shorter one never counts.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGNED = 6

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
# Of strings taken for random, the share that may not be.
FALSE_SHARE = 0.01
_BINS = 50
# Symbols of each encoding, in the order of their values, and the pattern that a string of it fits.
ENCODINGS = {
    "hex": ("0123456789abcdef", r"\A(?=.*[0-9])(?=.*[a-f])[0-9a-f]+\z"),
    "HEX": ("0123456789ABCDEF", r"\A(?=.*[0-9])(?=.*[A-F])[0-9A-F]+\z"),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"\A(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+={0,2}\z"),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", r"\A(?=.*[0-9])(?=.*[a-z])[0-9a-z]+\z"),
    "base62": (
        "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
        r"\A(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+\z",
    ),
    "base64": (
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
        r"\A(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+={0,2}\z",
    ),
    "base64url": (
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
        r"\A(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+={0,2}\z",
    ),
}


_SPANS = "array<struct<start:int,kind:int,stop:int,found:string>>"
# Matches that are added up one by one; longer lists are added up a block of so many at a time.
_BLOCK = 64


def _bound(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(sizes: Column) -> Column:
    """The sum of the sizes before each. Within blocks, and over blocks, so that the arrays that are
    copied for every element stay short."""
    def sums(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums"))

        def step(state: Column, size: Column) -> Column:
            return F.struct((state["at"] + size).alias("at"), F.concat(state["sums"], F.array(state["at"])).alias("sums"))

        return F.aggregate(values, start, step, lambda state: state["sums"])

    def whole(values: Column) -> Column:
        # An empty list has no block.
        numbers = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(numbers, lambda k: F.slice(values, k * _BLOCK + 1, F.lit(_BLOCK)))
        return _bound(blocks, joined)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda total, size: total + size))
        return F.flatten(F.zip_with(blocks, sums(totals), lambda block, base: F.transform(sums(block), lambda at: at + base)))

    return _bound(sizes, whole)


def _spans(text: Column, pattern: str, kind: int, keep=None, hint: Column | None = None) -> Column:
    """(start, kind, stop, found) of every match, leftmost first and none overlapping another.

    Between the matches stand the parts that the pattern splits the text into, so a match begins
    after as many characters as the parts and matches before it have.
    """
    def spans(matches: Column, parts: Column) -> Column:
        skips = F.transform(F.slice(parts, F.lit(1), F.size(matches)), lambda part: F.char_length(part))
        pairs = F.zip_with(matches, skips, lambda m, skip: F.struct(skip.alias("skip"), m.alias("found")))
        return _bound(pairs, placed)

    def placed(pairs: Column) -> Column:
        before = _running(F.transform(pairs, lambda pair: pair["skip"] + F.char_length(pair["found"])))
        return F.zip_with(pairs, before, span)

    def span(pair: Column, before: Column) -> Column:
        start = before + pair["skip"]
        stop = start + F.char_length(pair["found"])
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), pair["found"].alias("found"))

    found = spans(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))
    found = found if keep is None else F.filter(found, lambda span: keep(span["found"]))
    # Most texts have no match, and are not taken apart.
    match = F.rlike(text, F.lit(pattern))
    return F.when(match if hint is None else hint & match, found).otherwise(F.array().cast(_SPANS))


def _apart(more: Column, base: Column) -> Column:
    """Those of the spans `more` that overlap none of `base`.

    Spans of one kind are in order and overlap none of theirs, so of each kind only the last that
    begins before a span's end can reach into it; it is found by halving.
    """
    def last_stop(span: Column, own: Column) -> Column:
        steps = F.sequence(F.floor(F.log2(F.size(own) + 1)).cast("int"), F.lit(0), F.lit(-1))

        def step(n: Column, k: Column) -> Column:
            to = n + F.call_function("shiftleft", F.lit(1), k)
            return F.when((to <= F.size(own)) & (F.get(own, to - 1)["start"] < span["stop"]), to).otherwise(n)

        before = F.aggregate(steps, F.lit(0), step)
        return F.coalesce(F.get(own, before - 1)["stop"], F.lit(0))

    kinds = F.transform(F.array(*[F.lit(k) for k in range(3)]), lambda kind: F.filter(base, lambda span: span["kind"] == kind))
    return _bound(
        kinds, lambda by_kind: F.filter(more, lambda span: F.forall(by_kind, lambda own: last_stop(span, own) <= span["start"]))
    )


def base_spans(text: Column) -> Column:
    """The spans that patterns find, by start and then kind."""
    assigned = lambda found: F.char_length(F.regexp_extract(found, ASSIGN, 2)) >= ASSIGNED
    small = F.lower(text)
    named = F.contains(small, F.lit("passw"))
    for word in ("secret", "token", "api"):
        named = named | F.contains(small, F.lit(word))
    access = F.contains(text, F.lit("AKIA"))
    return F.array_sort(
        F.concat(
            _spans(text, ASSIGN, 0, assigned, hint=named), _spans(text, ACCESS, 1, hint=access), _spans(text, HEX, 2)
        )
    )


def _normal_tail(z: Column) -> Column:
    """P(|Z| > |z|), by a rational approximation of the error function (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / (2**0.5)
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), series * F.exp(-x * x))


def randomness(found: Column, symbols: Column) -> dict[str, Column]:
    """p-values of a string in an alphabet, low where it is not random.

    `values` are needed by name; see `_tested`. Chi-squared has an upper tail only: a string whose
    symbols are more even than by chance is no word.
    """
    n, size = F.size("values").cast("double"), F.char_length(symbols).cast("double")
    counts = F.transform(F.split(symbols, ""), lambda c: (F.char_length(found) - F.char_length(F.replace(found, c, F.lit("")))).cast("double"))
    squares = F.aggregate(counts, F.lit(0.0), lambda total, c: total + c * c)
    free = size - 1
    chi = squares * size / n - n
    # The cube root of chi-squared is nearly normal (Wilson and Hilferty, 1931).
    spread = 2 / (9 * free)
    z = (F.cbrt(F.greatest(chi, F.lit(0.0)) / free) - (1 - spread)) / F.sqrt(spread)
    uniform = F.when(z > 0, _normal_tail(z) / 2).otherwise(1 - _normal_tail(z) / 2)

    middle = (size - 1) / 2
    highs = F.transform("values", lambda v: (v > middle).cast("int"))
    up = F.aggregate(highs, F.lit(0.0), lambda total, v: total + v)
    down = n - up
    changes = F.aggregate(
        F.zip_with(F.slice(highs, 1, F.size("values") - 1), F.slice(highs, 2, F.size("values") - 1), lambda a, b: (a != b).cast("int")),
        F.lit(1.0),
        lambda total, v: total + v,
    )
    mean = 2 * up * down / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    runs = F.when(variance > 0, _normal_tail((changes - mean) / F.sqrt(variance))).otherwise(0.0)

    average = F.aggregate("values", F.lit(0.0), lambda total, v: total + v) / n
    spread_ = F.aggregate("values", F.lit(0.0), lambda total, v: total + (v - average) * (v - average))
    together = F.aggregate(
        F.zip_with(F.slice(F.col("values"), 1, F.size("values") - 1), F.slice(F.col("values"), 2, F.size("values") - 1), lambda a, b: (a - average) * (b - average)),
        F.lit(0.0),
        lambda total, v: total + v,
    )
    serial = F.when(spread_ > 0, _normal_tail((together / spread_ + 1 / n) * F.sqrt(n))).otherwise(0.0)
    return {"uniform": uniform, "runs": runs, "serial": serial}


def _encoding(found: Column) -> Column:
    """The first encoding whose characters a string has, or null."""
    result = F.lit(None).cast("string")
    for name, (_, pattern) in reversed(ENCODINGS.items()):
        result = F.when(F.rlike(found, F.lit(pattern)), name).otherwise(result)
    return result


def _tested(strings: DataFrame) -> DataFrame:
    """Distinct strings `found` that fit an encoding, with `p`, which is even for random ones: the chance
    that the least of three p-values is no higher."""
    fitting = strings.select("found").distinct().withColumn("encoding", _encoding(F.col("found"))).where("encoding IS NOT NULL")
    symbols = F.create_map(*[F.lit(x) for name, (chars, _) in ENCODINGS.items() for x in (name, chars)])[F.col("encoding")]
    body = F.rtrim(F.col("found"), F.lit("="))
    bare = fitting.withColumn("symbols", symbols).withColumn("body", body)
    place = F.transform(F.split("body", ""), lambda c: F.instr(F.col("symbols"), c) - 1)
    valued = bare.withColumn("values", place)
    tests = randomness(F.col("body"), F.col("symbols"))
    p = 1 - F.pow(1 - F.least(*tests.values(), F.lit(1.0)), len(tests))
    band = F.floor(F.log2(F.char_length("body")) * 2).cast("int")
    return valued.select("found", "encoding", band.alias("band"), p.alias("p"))


def random_strings(strings: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """Those of the distinct strings `found` that are random, of each encoding and length with
    about `false_share` at most that are not.

    Of each encoding and half-octave of lengths, p-values are counted in bins. Above one half nearly
    all are random, so twice their number estimates the random ones, and a bin's excess over its
    even share the others. The bins from the lowest that keeps the others' share small are taken,
    where small allows for the chance error of a count. Lengths at which no string is above one half
    are too sparse to tell, and take the limit of their whole encoding, or else of all. Counts cover all strings; what is kept of them is one row a bin.
    """
    tested = stored(_tested(strings), "tested-strings")
    binned = tested.withColumn("bin", F.least(F.lit(_BINS - 1), F.floor(F.col("p") * _BINS)).cast("int"))
    counts = binned.groupBy("encoding", "band", "bin").count()

    def strata(*keys: str) -> DataFrame:
        alike = counts.groupBy(*keys, "bin").agg(F.sum("count").alias("count"))
        return alike.groupBy(*keys).agg(
            F.sum("count").alias("n"),
            F.sum(F.when(F.col("bin") >= _BINS // 2, F.col("count")).otherwise(0)).alias("upper"),
            F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("bins"),
        )

    each = F.least(F.col("upper") * 2.0, F.col("n") * 1.0) / _BINS

    def above(first: Column) -> Column:
        """Strings in the bins from `first` on."""
        return F.aggregate(F.sequence(first, F.lit(_BINS - 1)), F.lit(0.0), lambda t, b: t + F.coalesce(F.col("bins")[b], F.lit(0)))

    good = F.filter(
        F.sequence(F.lit(1), F.lit(_BINS // 2)),
        lambda b: above(b) - each * (_BINS - b) <= false_share * above(b) + F.sqrt(above(b)),
    )
    lowest = F.array_min(good)
    own = strata("encoding", "band").select("encoding", "band", F.when(F.col("upper") > 0, lowest).alias("own"), (F.col("upper") > 0).alias("told"))
    # One row for each encoding, and one.
    wider = strata("encoding").select("encoding", lowest.alias("wider"), (F.col("upper") > 0).alias("wider_told"))
    widest = strata().select(lowest.alias("widest"))
    limits = own.join(F.broadcast(wider), "encoding").crossJoin(F.broadcast(widest))
    chosen = F.when(F.col("told"), F.col("own")).when(F.col("wider_told"), F.col("wider")).otherwise(F.col("widest"))
    limits = limits.select("encoding", "band", chosen.alias("lowest")).where("lowest IS NOT NULL")
    # At most one row for each encoding and half-octave.
    return binned.join(F.broadcast(limits), ["encoding", "band"]).where("bin >= lowest").select("found")


def find_secrets(documents: DataFrame, text: str = "text") -> DataFrame:
    """Every row of `documents`: a struct `row` of its columns but the text, and `spans`, structs of
    start, kind (a place in KINDS), stop and found, by start and then kind.

    Offsets are in code points, stops excluded. A null or empty text has none. Random strings are
    added where no pattern found anything; those of patterns always stay. Which strings are random
    is decided over all rows, so a row's answer can depend on the others. Repeated rows get equal
    answers. An empty table gives an empty one.

    Texts are searched where they lie and not shuffled. Only the long runs move, which are few, and
    come back by the text's hash.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    columns = [F.col(f"`{name}`") for name in documents.columns if name != text]
    ids = [F.xxhash64(value).alias("t1"), F.xxhash64(F.lit(1), value).alias("t2")]

    with scratch():
        # Hashed before they are exploded: beside an explosion they would be hashed again for every run.
        runs = documents.select(*ids, _spans(value, CANDIDATE, KINDS.index("random")).alias("spans"))
        runs = runs.select("t1", "t2", F.explode("spans").alias("span"))
        runs = stored(runs, "long-runs")
        random = stored(random_strings(runs.select("span.found")), "random-strings")
        found = runs.withColumn("found", F.col("span.found")).join(random, "found", "left_semi")
        found = stored(found.groupBy("t1", "t2").agg(F.collect_set("span").alias("more")), "random-spans", keep=True)

    rows = documents.select(F.struct(*columns).alias("row"), *ids, base_spans(value).alias("base"))
    rows = rows.join(found, ["t1", "t2"], "left")
    apart = _apart(F.col("more"), F.col("base"))
    both = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", apart)))
    return rows.select("row", both.alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:stop, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
