"""Secrets in text: fixed patterns, and strings that look random to character Markov models.

Two first-order models over characters, one of random strings and one of ordinary identifiers, are counted from a labelled table
``(sample, is_random)``, which may name the family of a sample: all families of a class weigh the same. A candidate is a run of at least ``MIN_LEN`` characters of ``[A-Za-z0-9+/_=-]`` that overlaps no
pattern match; it is a secret if the mean log-likelihood ratio of its steps is above ``threshold``.

Everything is expressions over the row, so a text never leaves its task. Positions are code points. Each pattern splits a text
once; positions are running sums of the lengths, taken in pieces so that no step copies all before it; steps are scored over
an array of characters; overlaps are found by binary search. So the work grows with the text and its matches in proportion, but
for a logarithm.

Defined results: null and empty texts have no spans and the hash of the empty string; repeated rows give repeated rows; an empty
table gives an empty table, with the fixed tables below as the only samples; columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of AKIA[A-Z0-9]+ with 18 characters or more
HEX = r"[0-9a-f]{16,}"
MIN_LEN = 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_-]{5,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ["assign", "access", "hex", "markov"]
TRAIN_DOCS = 2000
THRESHOLD = 0.5
BACK_OFF = 8.0  # steps, or BACK_SHARE of those seen if that is more
BACK_SHARE = 0.1
# a value with fewer runs of one kind of character for its length is made of words
RUN = "[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
RUN_LEN = 3
# the fixed labelled table: ``TOKENS`` random strings over each alphabet, and strings that are no secrets
ALPHABETS = {"base36": ALPHABET[52:62] + ALPHABET[26:52], "base62": ALPHABET[:62], "base64": ALPHABET[:64]}
TOKENS = 500
TOKEN_LEN = 40
ORDINARY = """
================ ---------------- ________________ //////////////// ++++++++++++++++ ================================
src/main/java/com/example/service/UserService /usr/local/share/documentation/index /home/user/projects/config/settings
www/static/images/header-background-2 articles/2023/10/14/annual-report 2024-01-15 2019-12-31/23-59-59
user_account_name customer_id order_line_item_total max_retry_count_10 get_value_2 test_case_001 step-by-step state-of-the-art
getUserNameById HttpRequestHandler parseXmlDocument createNewOrderItem MAX_BUFFER_SIZE DEFAULT_TIMEOUT_SECONDS ERROR_CODE_404
version-1-2-0 release_2021_04 chapter-12-section-3 utf-8-encoding size=1024 page=2 index=10 name=value and/or input/output
""".split()
PIECE = 128  # lengths that are added up one by one
SPAN = "array<struct<start:int,ord:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, merge: Callable[[Column, Column], Column], first: int) -> Column:
    """All values up to each place merged, ``first`` being neutral: within pieces, and then with what is before a piece."""
    none = F.expr("cast(array() as array<int>)")
    begin = F.struct(F.lit(first).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return _let(merge(acc["at"], x), lambda m: F.struct(m.alias("at"), F.concat(acc["out"], F.array(m)).alias("out")))

    def before(acc: Column, piece: Column) -> Column:
        total = merge(acc["at"], F.coalesce(F.get(piece, F.size(piece) - 1), F.lit(first)))
        return F.struct(total.alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def of(v: Column) -> Column:
        last = F.greatest(F.ceil(F.size(v) / PIECE).cast("int"), F.lit(1)) - 1
        pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * PIECE + 1, F.lit(PIECE)))
        inner = F.transform(pieces, lambda p: F.reduce(p, begin, step, lambda acc: acc["out"]))
        return _let(inner, lambda s: F.flatten(F.zip_with(s, F.reduce(s, begin, before, lambda acc: acc["out"]), lambda p, o: F.transform(p, lambda x: merge(o, x)))))

    return _let(values, of)


def _spans(text: Column, pattern: str, order: int, fits: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """start, order and end of each match, from the lengths of the matches and of what lies between them; ``fits`` is asked
    about a group of the match."""
    none = F.expr(f"cast(array() as {SPAN})")
    between = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(lengths: Column) -> Column:
        both = F.zip_with(F.slice(between, F.lit(1), F.size(lengths)), lengths, lambda a, b: a + b)
        ends = _running(both, lambda a, b: a + b, 0)
        return F.zip_with(ends, lengths, lambda e, n: F.struct((e - n).alias("start"), F.lit(order).alias("ord"), e.alias("end")))

    spans = _let(F.transform(found, F.length), placed)
    if fits is not None:
        ok = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), fits)
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("s"), ok.alias("ok")), lambda z: z["ok"]), lambda z: z["s"])
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _assign(text: Column) -> Column:
    return _spans(text, ASSIGN, 0, lambda v: F.length(v) >= 12, 2)


def random_token(family: str, k: int) -> str:
    """Token k over an alphabet: the digits of a hash, so the table is the same everywhere."""
    letters, x = ALPHABETS[family], int(hashlib.sha512(f"{family}:{k}".encode()).hexdigest(), 16)
    return "".join(letters[x // len(letters) ** i % len(letters)] for i in range(TOKEN_LEN))


def fixed_samples() -> list[tuple[str, bool, str]]:
    """The labelled table that does not depend on the texts: sample, is_random, family."""
    tokens = [(random_token(family, k), True, family) for family in ALPHABETS for k in range(TOKENS)]
    return tokens + [(w, False, "ordinary") for w in ORDINARY]


def _looks_random(v: Column) -> Column:
    """A value of an assignment that is long enough, has a digit and is not made of words."""
    runs = F.length(F.regexp_replace(v, RUN, "x"))
    return (F.length(v) >= 12) & v.rlike("[0-9]") & (runs * RUN_LEN > F.length(v))


def labelled_samples(docs: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(sample, is_random, family): the fixed table; what the fixed patterns find, assigned values only if they look random;
    and identifiers. Each of the two is from the ``train_docs`` texts with the smallest hash among those that have one.
    Bounded by train_docs; the whole text of each is used."""
    texts = docs.select(docs[text_col].alias("t")).dropna()

    def drawn(has: Column) -> DataFrame:
        # only hashes are ordered; the texts at or below the last of them are then read, each once
        some = texts.filter(has).withColumn("h", F.xxhash64("t"))
        last = some.select("h").distinct().orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
        return some.filter(F.col("h") <= F.lit(last).cast("long")).select("t").distinct()

    value, t = rf"{ACCESS}|{HEX}", F.col("t")
    assigned = F.filter(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), _looks_random)
    secrets = drawn(t.rlike(value) | (t.rlike(ASSIGN) & (F.size(assigned) > 0)))
    secrets = secrets.select(F.explode(F.array_union(F.regexp_extract_all("t", F.lit(value), F.lit(0)), assigned)).alias("sample"))
    rest = F.regexp_replace("t", ASSIGN, " ")  # what is assigned may be a secret, so it is no example of an identifier
    plain = drawn(t.rlike(IDENTIFIER)).select(F.explode(F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0))).alias("sample"))
    plain = plain.filter(~F.col("sample").rlike(value))
    fixed = docs.sparkSession.createDataFrame(fixed_samples(), "sample string, is_random boolean, family string")
    found = secrets.distinct().withColumn("is_random", F.lit(True)).unionByName(plain.distinct().withColumn("is_random", F.lit(False)))
    return found.withColumn("family", F.lit("found")).unionByName(fixed)


def step_scores(samples: DataFrame) -> list[float]:
    """log P(b | a) of random strings minus that of identifiers, at 128 * a + b. A step's probability is its share of the
    steps from a, mixed with the share of b as if ``BACK_OFF`` more steps, or ``BACK_SHARE`` of them, had been seen; so
    what a step that was never seen costs does not grow with the samples. The counts of a family are scaled so that all families of
    a class weigh the same, and a table with many hashes does not push the other alphabets out. The counts that reach
    the driver are at most one per pair of the alphabet, class and family."""
    chars = F.split(F.regexp_replace("sample", r"[^A-Za-z0-9+/_=-]", ""), "")
    family = F.coalesce("family", F.lit("")) if "family" in samples.columns else F.lit("")
    pairs = samples.dropna(subset=["sample", "is_random"]).select("is_random", family.alias("family"), chars.alias("c")).filter(F.size("c") > 1)
    pairs = pairs.select("is_random", "family", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.concat(F.get("c", i - 1), F.get("c", i)))).alias("p"))
    rows = pairs.groupBy("is_random", "family", "p").agg(F.count(F.lit(1)).alias("n")).collect()

    def model(kind: bool) -> dict[str, float]:
        sums: dict[str, int] = {}
        for r in rows:
            if r["is_random"] == kind:
                sums[r["family"]] = sums.get(r["family"], 0) + r["n"]
        counts: dict[str, float] = {}
        for r in sorted(rows):
            if r["is_random"] == kind:
                counts[r["p"]] = counts.get(r["p"], 0.0) + r["n"] * sum(sums.values()) / (len(sums) * sums[r["family"]])
        into = {b: sum(counts.get(a + b, 0.0) for a in ALPHABET) for b in ALPHABET}
        every = sum(into.values())
        into = {b: (1 - BACK_SHARE) * (n / every if every else 1 / len(ALPHABET)) + BACK_SHARE / len(ALPHABET) for b, n in into.items()}
        out = {}
        for a in ALPHABET:
            seen = sum(counts.get(a + b, 0.0) for b in ALPHABET)
            more = max(BACK_OFF, BACK_SHARE * seen)
            for b in ALPHABET:
                out[a + b] = (counts.get(a + b, 0.0) + more * into[b]) / (seen + more)
        return out

    random, plain = model(True), model(False)
    scores = [0.0] * (128 * 128)
    for step in random:
        scores[128 * ord(step[0]) + ord(step[1])] = round(math.log(random[step] / plain[step]), 6)
    return scores


def _apart(spans: Column, base: Column) -> Column:
    """Those spans that overlap none of ``base``: the furthest end among the spans that start before the end of one, by binary search."""

    def of(sorted_: Column) -> Column:
        furthest = _running(F.transform(sorted_, lambda b: b["end"]), F.greatest, 0)

        def among(z: Column) -> Column:
            def halve(acc: Column, _: Column) -> Column:
                middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
                below = F.get(z["starts"], middle) < acc["end"]
                open_ = acc["lo"] < acc["hi"]
                return F.struct(F.when(open_ & below, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~below, middle).otherwise(acc["hi"]).alias("hi"), acc["end"].alias("end"))

            def free(s: Column) -> Column:
                begin = F.struct(F.lit(0).alias("lo"), F.size(z["starts"]).alias("hi"), s["end"].alias("end"))
                n = F.reduce(F.sequence(F.lit(0), F.ceil(F.log2(F.size(z["starts"]) + 1)).cast("int")), begin, halve, lambda acc: acc["lo"])
                return F.coalesce(F.get(z["furthest"], n - 1), F.lit(0)) <= s["start"]

            return F.filter(spans, free)

        return _let(F.struct(F.transform(sorted_, lambda b: b["start"]).alias("starts"), furthest.alias("furthest")), among)

    return F.when(F.size(base) == 0, spans).otherwise(_let(F.array_sort(base), of))


def _random_spans(text: Column, base: Column, scores: list[float], threshold: float) -> Column:
    weights = F.from_json(F.lit(json.dumps(scores)), "array<double>")

    def likely(v: Column) -> Column:
        def mean(codes: Column) -> Column:
            n = F.size(codes)
            steps = F.zip_with(F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), lambda a, b: F.get(weights, a * 128 + b))
            return F.reduce(steps, F.lit(0.0), lambda acc, x: acc + x) / (n - 1)

        return _let(F.transform(F.filter(F.split(v, ""), lambda c: c != ""), F.ascii), mean) > threshold

    return _apart(_spans(text, CANDIDATE, 3, likely), base)


def _text_of(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kind, s["ord"]), s["start"], s["end"])))


def scan_secrets(
    docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """id, n_assign, n_access, n_hex, n_markov, base (text of the pattern spans), spans (text of all spans)."""
    scores = step_scores(samples)
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    t = F.col("t")
    rows = rows.select("id", "t", _assign(t).alias("a"), _spans(t, ACCESS, 1).alias("k"), _spans(t, HEX, 2).alias("h"))
    rows = rows.withColumn("base", F.concat("a", "k", "h"))
    rows = rows.withColumn("m", _random_spans(t, F.col("base"), scores, threshold))
    return rows.select(
        F.col("id").alias(id_col),
        F.size("a").cast("long").alias("n_assign"),
        F.size("k").cast("long").alias("n_access"),
        F.size("h").cast("long").alias("n_hex"),
        F.size("m").cast("long").alias("n_markov"),
        _text_of(F.col("base")).alias("base"),
        _text_of(F.concat("base", "m")).alias("spans"),
    )
