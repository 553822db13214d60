"""Secret scans in DataFrame operations only: three fixed forms, and a battery of randomness tests for the rest.

The fixed forms (`assign`, `access`, `hex`) are patterns. Beside them every unbroken run of 20 or more characters
of the base-64 alphabets is a candidate. Its encoding is inferred from its characters (digits, hex, base 32, one-case
letters with or without digits, letters, base 62, base 64), which gives an alphabet of k symbols. The battery looks at
three things: chi-squared for equal frequencies, the number of runs, and the lag-1 serial correlation. Each candidate is
held against two hypotheses:

*Drawn at random from that alphabet.* Chi-squared (standardised with the exact mean and variance of the statistic for n
draws, so that short strings are not misjudged), runs above and below the middle of the alphabet, and the serial
correlation of the symbols' ranks. Three times the least p-value counts.

*Written like the corpus.* Chi-squared, as the number of equal pairs of letters, against the letters of the corpus, and
the runs of letters, digits and capitals, against how often the corpus changes between them. What the corpus is like is
counted in all runs of 12 to 19 characters, which are too short to be candidates. Twice the lesser p-value counts.

Both p-values go through the Benjamini-Hochberg procedure at FALSE_SHARE, separately for each class of lengths, over all
candidates of the corpus: short runs carry little evidence and must not borrow it from long ones. Candidates for which
the second hypothesis falls and the first doesn't are added as spans of kind `random`. P-values are rounded up to a grid
of GRID steps, so the procedure needs only counts by class and step, a table of fixed size.

To leave out what the fixed forms have found, their characters are exchanged for twins of a private alphabet before
candidates are searched; places stay the same, and everything takes time in proportion to the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.frames import shielded
from tessera.sources.shared import forget, kept

# The three base forms.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run of [0-9a-f]+ that is 24 or longer is the whole run
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"(?<![\p{L}\p{N}])[A-Za-z0-9+/_-]{20,}+={0,2}(?![\p{L}\p{N}])"
CONTROL = r"(?<![\p{L}\p{N}+/_-])[A-Za-z0-9+/_-]{12,19}+(?![\p{L}\p{N}+/_-])"
FALSE_SHARE = 0.01
LENGTH_CLASSES = (32, 64)
GRID = 200  # steps of 0.1 in -log10 p
#: What a corpus is like before it is read, and how many letters and steps that counts as: sums of the squares and cubes
#: of 26 letter frequencies in proportion to 1 / (rank + 3), and the share of steps that change between kinds.
PRIOR = (0.0552, 0.0040, 0.1)
PRIOR_WEIGHT = 1000
CHUNK = 256

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
PLAIN = ALNUM + "+/_.=-:'\" "
SIGNS = "+/_=-"
TWINS = "[\uE000-\uE0FF]"
ASIDE = "[\uE000-\uE1FF]"


def _twin(c: str, block: int = 0xE000) -> str:
    return chr(block + ord(c))


def _either(c: str) -> str:
    """A class of a letter in either case and their twins."""
    return "[" + "".join(x + _twin(x) for x in (c.lower(), c.upper())) + "]"


def _word(w: str) -> str:
    return "".join(_either(c) if c.isalpha() else c for c in w)


# The base forms where letters and digits may have been exchanged for twins already: hex first, then access, then assign.
ACCESS_TWIN = "AKIA[A-Z0-9" + "".join(map(_twin, "0123456789")) + "]+"
ASSIGN_TWIN = f"({'|'.join(map(_word, ('password', 'passwd', 'secret', 'token')))}|{_word('api')}_?{_word('key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=" + "".join(map(_twin, ALNUM)) + "-]+)"

# name, pattern it fills, symbols in rank order, and how to fold the text before ranking; the first that fits holds
ENCODINGS = (
    ("digits", "^[0-9]+$", "0123456789"),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("alnum1", "^([a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("letters", "^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ONE_CASE = ("hex", "base32", "alnum1")
TWO_SIGNS = 2  # base 64 has two signs of the four above


def _let(value: Column, then) -> Column:
    """then(value), which may use it more than once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _sums(lengths: Column) -> Column:
    """Running sums of an array of ints, chunk by chunk: a chunk is short enough to be built by appending."""

    def running(chunk: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out"))
        return F.aggregate(chunk, begin, step)["out"]

    def whole(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x))
        return _let(running(totals, F.lit(0)), lambda ends: F.flatten(F.zip_with(chunks, F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1)), running)))

    chunks = lambda x: F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / CHUNK).cast("int")), lambda c: F.slice(x, c * CHUNK + 1, CHUNK))
    return _let(lengths, lambda x: F.when(F.size(x) > 0, whole(chunks(x))).otherwise(F.array().cast("array<int>")))


def _located(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<s,e,v>> of the leftmost non-overlapping matches, in code points; keep: a test of the match."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")

    def placed(v: Column) -> Column:
        ends = _sums(F.zip_with(v, F.slice(F.split(text, pattern, -1), 1, F.size(v)), lambda m, gap: F.length(m) + F.length(gap)))
        return F.zip_with(v, ends, lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("v")))

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    found = F.filter(found, keep) if keep else found
    return F.when(text.rlike(pattern), found).otherwise(none)


def _base_spans(text: Column) -> Column:
    """array<struct<start,kind_no,end>> of the fixed forms, in code points."""
    forms = (
        _located(text, ASSIGN, lambda m: F.length(F.regexp_extract(m["v"], ASSIGN, 2)) >= 6),
        _located(text, ACCESS, lambda m: m["e"] - m["s"] >= 20),
        _located(text, HEX),
    )
    return F.concat(*(_spans(found, i) for i, found in enumerate(forms)))


def _spans(found: Column, kind_no: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["s"].alias("start"), F.lit(kind_no).alias("kind_no"), m["e"].alias("end")))


def _exchanged(text: Column, pattern: str, of) -> Column:
    """The text with of(match) in place of every match."""
    parts = F.zip_with(F.split(text, pattern, -1), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of), lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def _hidden(m: Column) -> Column:
    return F.translate(m, PLAIN, "".join(map(_twin, PLAIN)))


def _without_base(text: Column) -> Column:
    """The text, as long as before, with twins for what the fixed forms match; signs next to them are set aside."""
    out = F.regexp_replace(text, ASIDE, "\u0001")
    out = _let(out, lambda t: _exchanged(t, HEX, _hidden))
    out = _let(out, lambda t: _exchanged(t, ACCESS_TWIN, lambda m: F.when(F.length(m) >= 20, _hidden(m)).otherwise(m)))
    out = _let(out, lambda t: _exchanged(t, ASSIGN_TWIN, lambda m: F.when(F.length(F.regexp_extract(m, ASSIGN_TWIN, 2)) >= 6, _hidden(m)).otherwise(m)))

    def aside(t: Column) -> Column:
        for c in SIGNS:
            t = F.regexp_replace(t, f"(?<={TWINS}[{SIGNS[:-1]}\uE100-\uE1FF-]{{0,8}})[{c}]|[{c}](?=[{SIGNS}]{{0,8}}{TWINS})", _twin(c, 0xE100))
        return t

    return _let(out, lambda t: F.when(t.rlike(TWINS), aside(t)).otherwise(t))


def _tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z: the approximation of Abramowitz and Stegun 26.2.17."""
    a = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _changes(c: Column, of=lambda a, b: a != b) -> Column:
    """Steps of an array at which its value changes."""
    last = F.greatest(F.size(c) - 1, F.lit(0))
    return F.size(F.filter(F.zip_with(F.slice(c, 1, last), F.slice(c, 2, last), of), lambda x: x)).cast("double")


def _switch_z(r: Column, share: float) -> Column:
    """Standardised number of steps between letter and digit, or from a small letter to a capital; signs are left out."""
    n = F.size(r["kinds"]).cast("double")
    seen = _changes(r["kinds"], lambda a, b: ((a < 3) != (b < 3)) | ((a == 1) & (b == 2)))
    return F.when(n >= 10, (seen - 0.5 - (n - 1) * share) / F.sqrt((n - 1) * share * (1 - share)))


def _times(text: Column, symbol: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, symbol, F.lit("")))).cast("double")


def _squares(text: Column, symbols: Column) -> Column:
    """Sum of the squared frequencies of the symbols (a string) in a text."""
    return F.aggregate(F.split(symbols, ""), F.lit(0.0), lambda s, c: s + F.pow(_times(text, c), F.lit(2.0)))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def _stage(array: Column, kept: tuple[str, ...], **fields) -> Column:
    """Each struct of the array with the fields `kept` and new ones, each a function of the old struct."""
    return F.transform(array, lambda r: F.struct(*(r[k].alias(k) for k in kept), *(f(r).alias(k) for k, f in fields.items())))


def _encoding(body: Column, of) -> Column:
    out = F.lit(None)
    for name, pattern, symbols in reversed(ENCODINGS):
        out = F.when(body.rlike(pattern), F.lit(of(name, symbols))).otherwise(out)
    return out


def _words_z(r: Column, s2: float, s3: float) -> Column:
    """Standardised number of equal pairs of letters, against letters with these sums of squares and cubes."""
    m = F.length(r["letters"]).cast("double")
    var = 2 * m * (m - 1) * s2 + 4 * m * (m - 1) * (m - 2) * s3 - 2 * m * (m - 1) * (2 * m - 3) * s2 * s2
    return F.when(m >= 10, (_squares(r["letters"], F.lit(LETTERS)) - m - m * (m - 1) * s2) / F.sqrt(var))


def _runs_z(r: Column) -> Column:
    n = r["n"]
    a = _sum(r["high"])
    mean, var = 2 * a * (n - a) / n + 1, 2 * a * (n - a) * (2 * a * (n - a) - n) / (n * n * (n - 1))
    return F.when(var > 0, F.greatest((F.abs(_changes(r["high"]) + 1 - mean) - 0.5) / F.sqrt(var), F.lit(0.0))).otherwise(F.lit(37.0))


def _serial_z(r: Column) -> Column:
    d, n = r["d"], r["n"]
    lagged = _sum(F.zip_with(F.slice(d, 1, F.size(d) - 1), F.slice(d, 2, F.size(d) - 1), lambda x, y: x * y))
    total = _sum(F.transform(d, lambda x: x * x))
    return F.when(total > 0, F.abs(lagged / total + 1 / n) * F.sqrt(n)).otherwise(F.lit(37.0))


def _scored(runs: Column, corpus: tuple[float, float, float]) -> Column:
    """Candidates (array<struct<s,e,v>>) with encoding, n, p_random and p_words."""
    s2, s3, share = corpus
    kept = ("s", "e", "v")
    a = _stage(runs, kept, body=lambda r: F.regexp_replace(r["v"], "=+$", ""))
    a = _stage(
        a, (*kept, "body"),
        encoding=lambda r: _encoding(r["body"], lambda name, _: name),
        symbols=lambda r: _encoding(r["body"], lambda _, symbols: symbols),
        k=lambda r: _encoding(r["body"], lambda name, symbols: float(len(symbols) - TWO_SIGNS * (name == "base64"))),
        n=lambda r: F.length(r["body"]).cast("double"),
        letters=lambda r: F.regexp_replace(F.lower(r["body"]), "[^a-z]", ""),
    )
    a = _stage(a, (*kept, "body", "encoding", "symbols", "k", "n", "letters"), folded=lambda r: F.when(r["encoding"].isin(*ONE_CASE), F.lower(r["body"])).otherwise(r["body"]))
    kept = (*kept, "encoding", "k", "n")
    a = _stage(
        a, (*kept, "letters", "folded", "symbols"),
        x=lambda r: F.transform(F.split(r["folded"], ""), lambda c: F.call_function("instr", r["symbols"], c).cast("double")),
        kinds=lambda r: F.transform(F.split(F.regexp_replace(r["body"], "[^A-Za-z0-9]", ""), ""), lambda c: F.when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3)),
    )
    a = _stage(a, (*kept, "letters", "folded", "symbols", "kinds", "x"), mean=lambda r: _sum(r["x"]) / r["n"])
    a = _stage(
        a, (*kept, "letters", "folded", "symbols", "kinds", "x"),
        d=lambda r: F.transform(r["x"], lambda x: x - r["mean"]),
        high=lambda r: F.transform(r["x"], lambda x: F.when(x > r["k"] / 2, 1.0).otherwise(0.0)),
    )
    a = _stage(
        a, kept,
        chi=lambda r: (r["k"] / r["n"] * _squares(r["folded"], r["symbols"]) - r["n"] - (r["k"] - 1)) / F.sqrt(2 * (r["k"] - 1) * (r["n"] - 1) / r["n"]),
        runs=_runs_z,
        serial=_serial_z,
        pairs=lambda r: _words_z(r, s2, s3),
        switch=lambda r: _switch_z(r, share),
    )
    return _stage(
        a, ("s", "e", "v", "encoding", "n"),
        p_random=lambda r: F.least(F.lit(1.0), 3 * F.least(_tail(r["chi"]), 2 * _tail(r["runs"]), 2 * _tail(r["serial"]))),
        p_words=lambda r: F.least(F.lit(1.0), 2 * F.least(F.coalesce(_tail(-r["pairs"]), F.lit(1.0)), F.coalesce(_tail(r["switch"]), F.lit(1.0)))),
    )


def _class(n: Column) -> Column:
    out = F.lit(0)
    for c in LENGTH_CLASSES:
        out = out + F.when(n >= c, 1).otherwise(0)
    return out


def _step(p: Column) -> Column:
    """-log10 p, rounded down to a step of the grid: the p-value is rounded up."""
    return F.least(F.lit(GRID), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * 10 + 1e-9)).cast("int")


def corpus_shape(df: DataFrame, text: str) -> tuple[float, float, float]:
    """(sum of squares, sum of cubes of the letter frequencies, share of steps that change between kinds) of all runs of
    12 to 19 characters of all texts, mixed with PRIOR_WEIGHT letters and steps of PRIOR."""
    runs = F.regexp_replace(F.array_join(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(CONTROL), F.lit(0)), "\n"), "[^A-Za-z0-9\n]", "")
    some = df.select(runs.alias("r")).withColumn("low", F.lower("r"))  # no filter: it would search the texts once more
    steps, changes = "[A-Za-z0-9](?=[A-Za-z0-9])", "[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])"
    total = lambda c: F.coalesce(F.sum(c.cast("double")), F.lit(0.0))
    n, changed, *counts = some.agg(total(F.regexp_count("r", F.lit(steps))), total(F.regexp_count("r", F.lit(changes))), *(total(_times(F.col("low"), F.lit(c))) for c in LETTERS)).first()
    m, w = sum(counts), PRIOR_WEIGHT
    s2, s3 = (sum((c / m) ** p for c in counts) if m else 0.0 for p in (2, 3))
    return (m * s2 + w * PRIOR[0]) / (m + w), (m * s3 + w * PRIOR[1]) / (m + w), (changed + w * PRIOR[2]) / (n + w)


def discovery_steps(scored: DataFrame, p: str) -> dict[int, int]:
    """For each class of lengths the least step whose candidates are discoveries; classes without any are missing."""
    counts = scored.groupBy(_class(F.col("n")).alias("c"), _step(F.col(p)).alias("step")).count()
    beyond = Window.partitionBy("c").orderBy(F.desc("step"))
    kept = counts.withColumns({"k": F.sum("count").over(beyond), "m": F.sum("count").over(Window.partitionBy("c"))})
    kept = kept.filter(F.pow(F.lit(10.0), -F.col("step") / 10) <= F.col("k") / F.col("m") * FALSE_SHARE)
    return {r[0]: r[1] for r in kept.groupBy("c").agg(F.min("step")).collect()}  # one row a class


def _judged(df: DataFrame, text: str) -> tuple[DataFrame, Column]:
    """(df with __base, the spans of the fixed forms, __rest, the text without them, and __scored; a test of a scored
    candidate)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rest = df.withColumn("__base", _base_spans(body)).withColumn("__rest", F.when(F.size("__base") > 0, _without_base(body)).otherwise(body))
    scored = rest.withColumn("__scored", _scored(_located(F.col("__rest"), CANDIDATE), corpus_shape(df, text)))
    # the outer form: for the other one the optimiser adds a filter that scores every text once more
    ps = scored.select(F.explode_outer("__scored").alias("r")).select("r.n", "r.p_words", "r.p_random").filter("n is not null")
    ps = kept(df.sparkSession, ps, "p-values")  # three numbers a candidate
    cuts = {p: discovery_steps(ps, p) for p in ("p_words", "p_random")}
    forget(ps)

    def discovered(r: Column, p: str) -> Column:
        least = F.lit(GRID + 1)
        for c, step in cuts[p].items():
            least = F.when(_class(r["n"]) == c, F.lit(step)).otherwise(least)
        return _step(r[p]) >= least

    return scored, lambda r: discovered(r, "p_words") & ~discovered(r, "p_random")


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `secrets`, array<struct<start, kind_no, end>> in code points, by start and then kind (see KINDS).

    A null or empty text has none. Repeated rows each get their spans, and count as often for the shape of the corpus
    and the false-discovery control; a table without rows gives none. A column named `secrets` is replaced, all others
    stay, whatever their names. Texts are read three times: for the shape of the corpus, for the p-values of the
    candidates, and for the spans; nothing is shuffled but counts of fixed size. A text takes time in proportion to its
    length, whatever it holds.
    """
    inside, restored = shielded(df.drop("secrets"), text)
    judged, test = _judged(inside, text)
    added = _spans(F.filter("__scored", test), len(KINDS) - 1)
    found = judged.withColumn("secrets", F.array_sort(F.concat("__base", added)))
    return restored(found, "secrets")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The text with every span of find_secrets replaced; spans that overlap or touch give one mark. Other columns stay.

    A text that holds characters of the private alphabet itself is cut span by span instead.
    """
    inside, restored = shielded(df, text)
    judged, test = _judged(inside, text)
    known = F.transform("__scored", lambda r: F.when(test(r), _hidden(r["v"])).otherwise(r["v"]))
    parts = F.zip_with(F.split("__rest", CANDIDATE, -1), known, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
    hidden = F.when(F.size("__scored") > 0, F.array_join(parts, "")).otherwise(F.col("__rest"))
    shown = F.translate(F.regexp_replace(hidden, f"{TWINS}+", mark.replace("\\", "\\\\").replace("$", "\\$")), "".join(_twin(c, 0xE100) for c in SIGNS), SIGNS)
    spans = F.array_sort(F.concat("__base", _spans(F.filter("__scored", test), len(KINDS) - 1)))

    def by_span(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        cut = F.aggregate(
            spans,
            start,
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"),
                F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
            ),
        )
        return _let(cut, lambda c: F.concat(c["out"], F.substring(F.col(text), c["at"] + 1, F.length(text))))

    return restored(judged.withColumn(text, F.when(F.col(text).rlike(ASIDE), _let(spans, by_span)).when(F.col(text).isNotNull(), shown)))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs)
    count = lambda i: F.size(F.filter("secrets", lambda s: s["kind_no"] == i)).cast("long")
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind_no"] + 1)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.filter("secrets", lambda s: s["kind_no"] < 3)), 256).alias("base_sha256"),
        joined("secrets").alias("spans"),
    )
