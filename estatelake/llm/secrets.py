"""Secret scan: fixed patterns, and a battery of randomness tests on every long token.

Candidates are tokens of 20 and more characters and, since a secret behind ordinary words is diluted in its token, also the pieces
of 20 and more letters and digits between a token's signs. Where a token and its pieces are found, the pieces stand for it if one
of them is far stronger, else the token does.

The battery asks of each distinct candidate whether it can be ordinary text of its alphabet. The null
hypothesis is ordinary text: letters come unevenly, kinds of characters (lower, upper, digit) change rarely, vowels and
consonants alternate. Three tests look for the opposite:

* uniformity: the chi-squared statistic against the uniform alphabet, written as the index of coincidence
  (sum of o(o-1) over n(n-1), which is (X2 + n - k) / k(n-1)), lies below that of text,
* runs: the kinds of characters change more often than in text,
* serial correlation: the lag-1 correlation of the vowel mark is higher than in text.

Their z values add up (each over the root of three) to one p value. Benjamini-Hochberg then holds the false discovery rate
within each stratum of encoding and length, so that many short tokens don't raise the bar for long ones or the reverse. It
counts distinct tokens, and works on a histogram of p values rounded up, so nothing but counts per bin is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelake.llm.common import stored

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LONG_HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # the same matches as HEX with 24 and more characters
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
# A run of letters and digits with a sign before or behind it, so a part of a token and not all of it.
PIECE = r"(?<=[+/_=-])[A-Za-z0-9]{20,}+|(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+(?=[+/_=-])"
STRONGER = 100.0  # how many times smaller a piece's p has to be than its token's
KINDS = ["assign", "access", "hex", "random"]

# Alphabets in the order in which they are tried: name, what a token has to look like, number of characters.
ENCODINGS = [
    ("decimal", r"^[0-9]+$", 10), ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 16), ("lower", r"^[a-z]+$", 26), ("upper", r"^[A-Z]+$", 26),
    ("base32", r"^[A-Z2-7]+=*$", 32), ("base36", r"^([0-9a-z]+|[0-9A-Z]+)$", 36), ("base62", r"^[0-9A-Za-z]+$", 62),
    ("base64", r"", 64),
]
# What text is like: sum of squared letter frequencies (at least this multiple of uniform), sum of cubes over its square,
# share of neighbours of different kinds, correlation of the vowel mark with that of the next character.
TEXT_COINCIDENCE, TEXT_OVER_UNIFORM, TEXT_CUBES, TEXT_CHANGES, TEXT_SERIAL = 0.065, 1.75, 1.3, 0.15, -0.25
BINS_PER_DECADE, LAST_BIN = 10, 300


def _spans(text: Column, found: Column, pattern: str) -> Column:
    """Code-point spans of the matches ``found`` of a pattern, from the lengths of the texts between them."""
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,token:string>>").alias("spans"))

    def step(acc, pair):
        a = acc.at + F.length(pair.gap)
        b = a + F.length(pair.token)
        return F.struct(b.alias("at"), F.array_append(acc.spans, F.struct(a.alias("start"), b.alias("end"), pair.token.alias("token"))).alias("spans"))

    pairs = F.zip_with(found, between, lambda m, g: F.struct(m.alias("token"), g.alias("gap")))
    pairs = F.slice(pairs, 1, F.size(found))
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda acc: acc.spans)).otherwise(none)


def pattern_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds assign, access, hex, tokens and pieces: the spans of the patterns, of the long tokens and of their long pieces in a text
    without nulls."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": LONG_HEX, "tokens": TOKEN, "pieces": PIECE}
    found = df.withColumns({f"__{k}": F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for k, p in patterns.items()})
    spans = found.withColumns({k: _spans(F.col(text), F.col(f"__{k}"), p) for k, p in patterns.items()})
    return spans.withColumns({
        "assign": F.filter("assign", lambda s: F.length(F.regexp_extract(s.token, ASSIGN, 2)) >= 6),
        "access": F.filter("access", lambda s: s.end - s.start >= 20),
    }).drop(*[f"__{k}" for k in patterns])


def _upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z) by the five-term formula (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    terms = t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * terms
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Adds encoding, size (characters of the alphabet), chi_squared, z_uniform, z_runs, z_serial and p to distinct tokens.

    Decimal numbers are no candidates: their digits are even in ordinary data as well. Their p is 1.
    """
    c = F.col(token)
    name, size = F.lit(ENCODINGS[-1][0]), F.lit(ENCODINGS[-1][2])
    for e, look, k in reversed(ENCODINGS[:-1]):
        name, size = F.when(c.rlike(look), e).otherwise(name), F.when(c.rlike(look), k).otherwise(size)
    # Signs join words in paths and names, so they stand for no kind of their own.
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[+/_=-]", ""), "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d")
    # A digit 1 is no vowel, so digits go first.
    vowel = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "x"), "(?i)[aeiou]", "1"), "[^1]", "0")
    n = F.length(c).cast("double")
    frame = tokens.withColumns({"encoding": name, "size": size, "__n": n, "__chars": F.split(c, ""), "__kind": kind, "__vowel": vowel})
    counts = F.transform(F.array_distinct("__chars"), lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))).cast("double"))
    squares = F.aggregate(counts, F.lit(0.0), lambda a, o: a + o * o)
    changes = lambda s: F.when(F.length(s) > 1, F.size(F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(F.col(s), i, F.lit(1)) != F.substring(F.col(s), i + 1, F.lit(1))
    ))).otherwise(0).cast("double")
    frame = frame.withColumns({
        "__squares": squares, "__changes": changes("__kind"), "__turns": changes("__vowel"), "__pairs": F.greatest(F.length("__kind") - 1, F.lit(1)).cast("double"),
        "__ones": F.length(F.replace("__vowel", F.lit("0"), F.lit(""))).cast("double"),
    })
    n, k = F.col("__n"), F.col("size").cast("double")
    s2 = F.greatest(F.lit(TEXT_COINCIDENCE), TEXT_OVER_UNIFORM / k)
    s3 = TEXT_CUBES * s2 * s2
    coincidence = (F.col("__squares") - n) / (n * (n - 1))
    spread = F.sqrt(2 / (n * (n - 1)) * (s2 - s2 * s2 + 2 * (n - 2) * (s3 - s2 * s2)))
    share = F.col("__ones") / n
    # Of a 0/1 sequence, from the number of turns: 1 - turns / (expected turns when independent).
    serial = F.when(share * (1 - share) > 0, 1 - F.col("__turns") / ((n - 1) * 2 * share * (1 - share))).otherwise(TEXT_SERIAL)
    frame = frame.withColumns({
        "chi_squared": k / n * F.col("__squares") - n,
        "z_uniform": (s2 - coincidence) / spread,
        "z_runs": (F.col("__changes") - F.col("__pairs") * TEXT_CHANGES) / F.sqrt(F.col("__pairs") * TEXT_CHANGES * (1 - TEXT_CHANGES)),
        "z_serial": (serial - TEXT_SERIAL) * F.sqrt(n),
    })
    z = (F.col("z_uniform") + F.col("z_runs") + F.least(F.col("z_serial"), F.lit(3.0))) / 3**0.5
    p = F.when(F.col("encoding") == "decimal", 1.0).otherwise(_upper_tail(z))
    return frame.withColumn("p", p).drop("__n", "__chars", "__kind", "__vowel", "__squares", "__changes", "__turns", "__ones", "__pairs")


def discoveries(tested: DataFrame, rate: float = 0.01, token: str = "token") -> DataFrame:
    """Those of the tested distinct tokens that are found at the false discovery rate within their stratum."""
    length = F.length(token)
    band = F.when(length < 32, 20).when(length < 48, 32).when(length < 96, 48).otherwise(96)
    bin_ = F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-31))) * BINS_PER_DECADE), F.lit(LAST_BIN)).cast("int")
    binned = tested.withColumns({"band": band, "bin": F.greatest(bin_, F.lit(0))})
    stratum = ["encoding", "band"]
    bins = binned.groupBy(*stratum, "bin").agg(F.count("*").alias("n"))  # at most 301 bins in each of 32 strata
    down = Window.partitionBy(*stratum).orderBy(F.desc("bin"))
    ranked = bins.withColumns({"found": F.sum("n").over(down), "all": F.sum("n").over(Window.partitionBy(*stratum))})
    edge = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    cut = ranked.where(edge <= rate * F.col("found") / F.col("all")).groupBy(*stratum).agg(F.min("bin").alias("cut"))
    return binned.join(F.broadcast(cut), stratum).where("bin >= cut").select(token, "encoding", "p")


def _of_kind(kind: str) -> Column:
    number = F.lit(KINDS.index(kind)).alias("n")
    return F.transform(kind, lambda s: F.struct(s.start.alias("start"), number, F.lit(kind).alias("kind"), s.end.alias("end"), s.token.alias("token")))


def strongest(found: DataFrame, row: list[str]) -> DataFrame:
    """Of the found candidates (start, end, p and ``whole``, true for a token) of each row those that stand: a token, or its pieces.

    Tokens never overlap and a piece lies in one token, so in order of their starts one pass tells a piece's token.
    """
    order = Window.partitionBy(*row).orderBy("start", F.desc("end"), F.desc("whole"))
    token = F.last(F.when(F.col("whole"), F.struct("start", "end")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = found.withColumn("__token", token)
    inside = F.coalesce(F.col("__token.end") >= F.col("end"), F.lit(False))
    placed = placed.withColumn("__group", F.when(inside, F.col("__token.start")).otherwise(F.col("start")))
    group = Window.partitionBy(*row, "__group")
    best, of_token = F.min(F.when(~F.col("whole"), F.col("p"))).over(group), F.min(F.when(F.col("whole"), F.col("p"))).over(group)
    by_pieces = of_token.isNull() | F.coalesce(best * STRONGER <= of_token, F.lit(False)) & (of_token > 0)
    return placed.withColumn("__pieces", by_pieces).where(F.col("whole") != F.col("__pieces")).drop("__token", "__group", "__pieces")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = 0.01) -> DataFrame:
    """One row per row of ``docs``: the key and ``spans``, an array of (start, kind number, kind, end, token) in order.

    A null text counts as empty and gives no spans; repeated rows get the same spans. A long token or piece that overlaps a
    pattern's span is not named twice. Only the key, a hash of the text and the spans are written and shuffled, never the texts; a token
    that many documents share is tested once and found again by a join that adaptive execution may split.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    scanned = stored(pattern_spans(docs.select(F.col(key), content.alias("__text")), "__text").withColumn("same", F.xxhash64("__text")).drop("__text"))
    scanned = scanned.withColumn("base", F.concat(*[_of_kind(k) for k in KINDS[:3]]))
    def free(name: str, whole: bool) -> Column:
        apart = F.filter(name, lambda t: ~F.exists("base", lambda b: (b.start < t.end) & (t.start < b.end)))
        return F.transform(apart, lambda t: F.struct(t.start.alias("start"), t.end.alias("end"), t.token.alias("token"), F.lit(whole).alias("whole")))

    candidates = F.concat(free("tokens", True), free("pieces", False))
    long = scanned.where(F.size("tokens") > 0).select(key, "same", F.explode(candidates).alias("t")).select(key, "same", "t.*")
    flagged = discoveries(battery(long.select("token").distinct()), rate).select("token", "p")
    found = long.join(flagged, "token").distinct()
    more = strongest(found, [key, "same"]).groupBy(key, "same").agg(F.collect_set(
        F.struct("start", F.lit(3).alias("n"), F.lit(KINDS[3]).alias("kind"), "end", "token")
    ).alias("more"))
    same_key = F.col("s." + key).eqNullSafe(F.col("m." + key)) & (F.col("s.same") == F.col("m.same"))
    none = F.array().cast("array<struct<start:int,n:int,kind:string,end:int,token:string>>")
    spans = F.array_sort(F.concat("s.base", F.coalesce("m.more", none)))
    return scanned.alias("s").join(more.alias("m"), same_key, "left").select(F.col("s." + key), spans.alias("spans"))
