"""Secret scans in DataFrame functions alone: fixed patterns, and a randomness test battery.

Long tokens are tested against the uniform distribution of the encoding they seem to be in:
chi-squared over the whole alphabet, chi-squared over its classes, the runs test and lag-one
serial correlation, joined by Fisher's statistic.  What a statistic says of a token depends on how
ordinary tokens of its length score, so the null is ordinary text: decoys of the tokens' own lengths,
cut from the running text of the same documents, give the mean of the statistic's logarithm as a
line in that of the length.  A token's p-value is the chance that ordinary text looks as random;
Benjamini-Hochberg in strata of length flags the rejections, so that of the flagged tokens at most
the chosen share is expected to be ordinary.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free_name, materialize, text_of

# The base kinds' patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # as maximal runs, then 32 or more: the same spans
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
_STRATA = (24, 32, 48, 96)  # upper bounds of token lengths; one more stratum above
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings: symbols, and the last symbol (from 1) of each class of neighbouring ones.
_ALPHABETS = {
    "hex": ("0123456789abcdef", (4, 8, 12, 16)),
    "HEX": ("0123456789ABCDEF", (4, 8, 12, 16)),
    "base32": (_LETTERS + "234567", (8, 16, 26, 32)),
    "base62": (_LETTERS + _LETTERS.lower() + "0123456789", (13, 26, 39, 52, 62)),
    "base64": (_LETTERS + _LETTERS.lower() + "0123456789+/", (13, 26, 39, 52, 62, 64)),
}
_SPANS = "array<struct<s:int,e:int,v:string>>"
_TOKENS = "array<struct<s:int,e:int,v:string,p:double,half:double>>"
#: Matches that one step of a fold handles: a fold's cost grows with the square of its steps.
_CHUNK = 128
#: The null before any decoy is seen, measured on prose of several languages; it counts as PRIOR_DECOYS decoys whose
#: logarithms of length have mean PRIOR_X[0] and deviation PRIOR_X[1].
PRIOR_NULL = (1.6, 0.67, 0.25)
PRIOR_DECOYS = 50
PRIOR_X = (3.5, 0.3)


def let(x: Column, body) -> Column:
    """body(x), with x evaluated once."""
    return F.element_at(F.transform(F.array(x), body), 1)


def spans(text: Column, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Leftmost non-overlapping matches whose group has at least `least` characters.

    The text between matches (split) and the matches themselves give the positions, in code points.
    Positions are running sums, taken chunk by chunk.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        found = F.when(x["m"].isNotNull() & (F.length(x["v"]) >= least), F.concat(acc["spans"], F.array(F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v"))))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), found.alias("spans"))

    def within(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("spans")), step, lambda acc: acc["spans"])

    def size(chunk: Column) -> Column:
        return F.aggregate(chunk, F.lit(0), lambda acc, x: acc + x["gap"] + F.coalesce(F.length(x["m"]), F.lit(0)))

    def begins(chunks: Column) -> Column:
        return F.aggregate(chunks, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + size(c))), lambda acc: F.slice(acc, F.lit(1), F.size(acc) - 1))

    steps = F.arrays_zip(gaps.alias("gap"), whole.alias("m"), value.alias("v"))
    return F.flatten(let(_chunked(steps), lambda chunks: F.zip_with(chunks, begins(chunks), within)))


def _chunked(xs: Column) -> Column:
    """An array cut into arrays of _CHUNK elements."""
    return let(xs, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(x) - 1), F.lit(_CHUNK)), lambda i: F.slice(x, i + 1, F.lit(_CHUNK))))


def decoys(text: Column, tokens: Column) -> Column:
    """For each token the same number of symbols of the document's running text, all else left out; of too little text none."""
    prose = F.regexp_replace(text, f"{TOKEN}|[^A-Za-z0-9+/_=-]+", "")

    def cut(prose: Column, x: Column, i: Column) -> Column:
        n = F.length(x["v"])
        at = F.pmod(i * 7919, F.greatest(F.lit(1), F.length(prose) - n)) + 1
        return F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.substring(prose, at, n).alias("v"))

    return let(prose, lambda p: F.filter(F.transform(tokens, lambda x, i: cut(p, x, i)), lambda d: F.length(d["v"]) >= 20))


def with_spans(docs: DataFrame, column: str) -> DataFrame:
    """docs with a struct of arrays of spans: assign, access, hex, tokens, decoys.  Cheap tests that each kind needs come first."""
    text, none = F.coalesce("text", F.lit("")), F.array().cast(_SPANS)
    has, raw = free_name(docs, "has_token"), free_name(docs, "raw_tokens")
    first = docs.select("*", text.rlike(f"(?<![A-Za-z0-9+/_=-]){TOKEN}").alias(has))
    first = first.select("*", F.when(F.col(has), spans(text, TOKEN, 0, 20)).otherwise(none).alias(raw))
    scored = lambda xs: F.when(F.col(has), with_p(xs)).otherwise(F.array().cast(_TOKENS))
    return first.select(
        *docs.columns,
        F.struct(
            F.when(text.contains(":") | text.contains("="), spans(text, ASSIGN, 2, 8)).otherwise(none).alias("assign"),
            F.when(text.contains("AKIA"), spans(text, ACCESS, 0, 16)).otherwise(none).alias("access"),
            F.when(F.col(has), spans(text, HEX, 0, 32)).otherwise(none).alias("hex"),
            scored(F.col(raw)).alias("tokens"),
            scored(decoys(text, F.col(raw))).alias("decoys"),
        ).alias(column),
    )


def _p_upper(z: Column) -> Column:
    """P(Z > z) for a standard normal, by a logistic approximation."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _encoding(v: Column) -> Column:
    return (
        F.when(v.rlike("^[0-9a-f]+$"), "hex").when(v.rlike("^[0-9A-F]+$"), "HEX").when(v.rlike("^[A-Z2-7]+$"), "base32")
        .when(v.rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64")
    )


def with_p(tokens: Column) -> Column:
    """tokens with half (half of Fisher's statistic of the battery, padding left out) and p, its p-value for a uniform token.

    p is 0 for a token of under 16 symbols.  Fields are computed stage by stage, so that each is
    evaluated once for a token.
    """
    pick = lambda x, i: reduce(lambda out, kv: F.when(x["kind"] == kv[0], i(kv[1])).otherwise(out), _ALPHABETS.items(), i(_ALPHABETS["base64"]))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))

    def bare(x: Column) -> dict[str, Column]:
        return {"bare": F.translate(F.regexp_replace(x["v"], "=+$", ""), "-_", "+/")}

    def kind(x: Column) -> dict[str, Column]:
        return {"kind": _encoding(x["bare"]), "n": F.greatest(F.length(x["bare"]), F.lit(2)).cast("double")}

    def alphabet(x: Column) -> dict[str, Column]:
        return {"alphabet": pick(x, lambda a: F.lit(a[0])), "tops": pick(x, lambda a: F.array(F.lit(0), *map(F.lit, a[1])))}

    def codes(x: Column) -> dict[str, Column]:
        chars = F.filter(F.split(x["bare"], ""), lambda c: c != "")
        return {"k": F.length(x["alphabet"]).cast("double"), "codes": F.transform(chars, lambda c: F.instr(x["alphabet"], c))}

    def tallies(x: Column) -> dict[str, Column]:
        a, b = F.slice(x["codes"], F.lit(1), F.greatest(F.lit(0), F.size(x["codes"]) - 1)), F.slice(x["codes"], F.lit(2), F.size(x["codes"]))
        mean = (x["k"] + 1) / 2
        own = F.transform(F.sequence(F.lit(1), F.size(x["tops"]) - 1), lambda i: F.size(F.filter(x["codes"], lambda c: (c > F.get(x["tops"], i - 1)) & (c <= F.get(x["tops"], i)))))
        part = F.transform(F.sequence(F.lit(1), F.size(x["tops"]) - 1), lambda i: (F.get(x["tops"], i) - F.get(x["tops"], i - 1)) / x["k"])
        return {
            "counts": F.transform(F.sequence(F.lit(1), x["k"].cast("int")), lambda i: F.size(F.filter(x["codes"], lambda c: c == i)).cast("double")),
            "own": own, "part": part,
            "high": F.size(F.filter(x["codes"], lambda c: c > x["k"] / 2)).cast("double"),
            "turns": F.size(F.filter(F.zip_with(a, b, lambda c, d: (c > x["k"] / 2) != (d > x["k"] / 2)), lambda t: t)).cast("double"),
            "serial": total(F.zip_with(a, b, lambda c, d: (c - mean) * (d - mean)), lambda v: v),
        }

    def statistics(x: Column) -> dict[str, Column]:
        n, k = x["n"], x["k"]
        return {
            "chi": k / n * total(x["counts"], lambda c: c * c) - n,
            "chi_class": total(F.zip_with(x["own"], x["part"], lambda o, p: (o - n * p) * (o - n * p) / (n * p)), lambda v: v),
            "df": F.size(x["own"]) - F.lit(1.0),
            "mean_runs": 2 * x["high"] * (n - x["high"]) / n + 1,
        }

    def scores(x: Column) -> dict[str, Column]:
        n, k, df = x["n"], x["k"], x["df"]
        var_runs = (x["mean_runs"] - 1) * (x["mean_runs"] - 2) / (n - 1)
        return {
            "z_chi": (x["chi"] - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n),
            "z_class": (F.pow(x["chi_class"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)),
            "z_runs": F.when(var_runs > 0, F.abs(x["turns"] + 1 - x["mean_runs"]) / F.sqrt(var_runs)).otherwise(8.0),
            "z_serial": F.abs(x["serial"]) / ((k * k - 1) / 12 * F.sqrt(n - 1)),
        }

    def fisher(x: Column) -> dict[str, Column]:
        ps = (_p_upper(x["z_chi"]), _p_upper(x["z_class"]), 2 * _p_upper(x["z_runs"]), 2 * _p_upper(x["z_serial"]))
        return {"half": -reduce(Column.__add__, [F.log(F.greatest(F.lit(1e-15), F.least(F.lit(1.0), p))) for p in ps])}

    def tail(x: Column) -> dict[str, Column]:  # chi-squared with 8 degrees of freedom
        h = x["half"]
        return {"p": F.when(x["n"] >= 16, F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)).otherwise(0.0)}

    fields = ["s", "e", "v"]
    for stage in (bare, kind, alphabet, codes, tallies, statistics, scores, fisher, tail):
        tokens, fields = _with_fields(tokens, fields, stage)
    return F.transform(tokens, lambda x: F.struct(*[x[f].alias(f) for f in ("s", "e", "v", "p", "half")]))


def _with_fields(tokens: Column, fields: list[str], stage) -> tuple[Column, list[str]]:
    """tokens with the fields that stage adds to each, and all fields' names."""
    new: list[str] = []

    def wider(x: Column) -> Column:
        more = stage(x)
        new[:] = list(more)
        return F.struct(*[x[f].alias(f) for f in fields], *[c.alias(f) for f, c in more.items()])

    return F.transform(tokens, wider), fields + new


def stratum(v: Column) -> Column:
    out = F.lit(len(_STRATA))
    for i, top in reversed(list(enumerate(_STRATA))):
        out = F.when(F.length(v) < top, i).otherwise(out)
    return out


def null_of(scanned: DataFrame, column: str) -> tuple[float, float, float]:
    """(a, b, sd): under the null, ln(1 + half) of a token of n symbols has mean a + b ln n and deviation sd.

    Least squares over all decoys together with PRIOR_DECOYS of the prior, whose part fades as decoys grow in number;
    the rule is the same at every size.
    """
    d = scanned.select(F.explode(f"{column}.decoys").alias("t")).select(F.log1p(F.col("t.half")).alias("u"), F.log(F.length("t.v")).alias("x"))
    r = d.agg(F.count("u").alias("n"), F.avg("x").alias("x"), F.avg("u").alias("u"), F.var_pop("x").alias("xx"), F.covar_pop("x", "u").alias("xu"), F.var_pop("u").alias("uu")).first()
    return with_prior(r["n"], *[r[k] or 0.0 for k in ("x", "u", "xx", "xu", "uu")])


def with_prior(n: int, x: float, u: float, xx: float, xu: float, uu: float) -> tuple[float, float, float]:
    """The null from n decoys' means, variances and covariance of x = ln n and u = ln(1 + half), pooled with the prior's."""
    (a, b, sd), (px, pd), share = PRIOR_NULL, PRIOR_X, n / (n + PRIOR_DECOYS)
    dx, du = x - px, u - (a + b * px)

    def pooled(own: float, prior: float, apart: float) -> float:
        return share * own + (1 - share) * prior + share * (1 - share) * apart

    vx = pooled(xx, pd * pd, dx * dx)
    slope = pooled(xu, b * pd * pd, dx * du) / vx
    rest = pooled(uu, b * b * pd * pd + sd * sd, du * du) - slope * slope * vx
    mean_x, mean_u = px + share * dx, a + b * px + share * du
    return mean_u - slope * mean_x, slope, max(0.05, max(0.0, rest) ** 0.5)


def p_ordinary(t: Column, null: tuple[float, float, float]) -> Column:
    """The chance that ordinary text of the token's length looks as random as the token, or more."""
    a, b, sd = null
    return _p_upper((a + b * F.log(F.length(t["v"])) - F.log1p(t["half"])) / sd)


def thresholds(scanned: DataFrame, column: str, null: tuple[float, float, float], fdr: float = 0.01) -> list[float]:
    """Benjamini-Hochberg cut of each length stratum over all tokens of all documents.

    p-values are counted in bins of a twentieth of a decade, so what is gathered is bounded by
    strata times bins; a bin counts with its upper edge, so the control holds.
    """
    # Equal tokens of one text stay apart: the family is every token occurrence.
    p = scanned.select(F.explode(f"{column}.tokens").alias("t")).select(stratum(F.col("t.v")).alias("stratum"), p_ordinary(F.col("t"), null).alias("p"))
    bins = F.ceil(20 * F.log10(F.greatest(F.lit(1e-20), "p"))).alias("bin")
    counts = p.select("stratum", bins).groupBy("stratum", "bin").count()
    below = Window.partitionBy("stratum").orderBy("bin")
    all_of = Window.partitionBy("stratum")
    edge = F.pow(F.lit(10.0), F.col("bin") / 20)
    passed = counts.select("stratum", edge.alias("edge"), F.sum("count").over(below).alias("k"), F.sum("count").over(all_of).alias("m"))
    cut = passed.where(F.col("edge") <= fdr * F.col("k") / F.col("m")).groupBy("stratum").agg(F.max("edge").alias("cut"))
    found = {r["stratum"]: r["cut"] for r in cut.collect()}  # one row for each stratum
    return [found.get(i, 0.0) for i in range(len(_STRATA) + 1)]


def scan(docs: DataFrame, column: str = "secrets", fdr: float = 0.01, least_p: float = 1e-4) -> DataFrame:
    """docs with one more column: a struct of assign, access, hex, random, arrays of spans (s, e, v) in code points.

    random: tokens of 20 or more characters that ordinary text does not explain (see thresholds())
    and that the battery itself does not reject as uniform at least_p.  Null text has no spans.
    Rows are scanned one by one, so repeated rows get equal spans.  Texts are scanned once and
    written with what was found; only the bounded histogram of p-values is shuffled.  A column of
    that name in docs is an error.  An empty table gives no rows.
    """
    if column in docs.columns:
        raise ValueError(f"docs has a column {column}")
    return _flagged(materialize(with_spans(docs, column), "spans"), column, fdr, least_p)


def _flagged(scanned: DataFrame, column: str, fdr: float = 0.01, least_p: float = 1e-4) -> DataFrame:
    """scanned, a written table, with the tokens that are flagged in place of all tokens and decoys."""
    null = null_of(scanned, column)
    cuts = thresholds(scanned, column, null, fdr)

    def is_random(t: Column) -> Column:
        level = F.lit(cuts[-1])
        for i, c in enumerate(cuts[:-1]):
            level = F.when(stratum(t["v"]) == i, c).otherwise(level)
        return (t["p"] >= least_p) & (p_ordinary(t, null) <= level)

    found = F.col(column)
    random = F.transform(F.filter(found["tokens"], is_random), lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), t["v"].alias("v")))
    return scanned.withColumn(column, F.struct(*[found[k].alias(k) for k in KINDS[:3]], random.alias("random")))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of every document."""
    text = text_of(docs)
    scanned = with_spans(text, "secrets").drop("text")
    found = _flagged(materialize(scanned, "spans"), "secrets").select("doc_id", "secrets.*")

    def labelled(kind: str, rank: int) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("i"), F.concat_ws(":", F.lit(kind), x["s"], x["e"]).alias("t")))

    def joined(kinds: tuple[str, ...]) -> Column:
        parts = F.concat(*[labelled(k, i) for i, k in enumerate(kinds)])
        return F.array_join(F.transform(F.array_sort(parts), lambda x: x["t"]), ",")

    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(KINDS[:3]), 256).alias("base_sha256"), joined(KINDS).alias("spans"), count("random"))


_RUNS = "array<struct<s:int,e:int>>"


def _merged(every: Column) -> Column:
    """Maximal runs of overlapping or touching spans, from spans sorted by start; chunk by chunk, then the chunks' runs."""

    def last(acc: Column, field: str) -> Column:
        return F.try_element_at(acc, F.lit(-1))[field]

    def pair(s: Column, e: Column) -> Column:
        return F.array(F.struct(s.alias("s"), e.alias("e")))

    def one(acc: Column, x: Column) -> Column:
        joins = (F.size(acc) > 0) & (x["s"] <= last(acc, "e"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), pair(last(acc, "s"), F.greatest(last(acc, "e"), x["e"])))).otherwise(F.concat(acc, F.array(x)))

    def many(acc: Column, runs: Column) -> Column:
        touched = F.filter(runs, lambda r: r["s"] <= last(acc, "e"))
        far = F.filter(runs, lambda r: r["s"] > last(acc, "e"))
        wider = pair(last(acc, "s"), F.greatest(last(acc, "e"), F.coalesce(F.array_max(F.transform(touched, lambda r: r["e"])), F.lit(0))))
        return F.when(F.size(acc) == 0, runs).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), wider, far))

    none = F.array().cast(_RUNS)
    chunks = F.transform(_chunked(every), lambda c: F.aggregate(c, none, one))
    return F.aggregate(chunks, none, many)


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with each maximal run of overlapping spans replaced by mask; n_chars follows the text.

    Documents without spans, null texts among them, are unchanged.  All columns of docs keep their
    names and, but for text and n_chars, their values.
    """
    column, runs = free_name(docs, "secrets"), free_name(docs, "runs")
    found = scan(docs, column)
    every = F.array_sort(F.concat(*[F.transform(F.col(f"{column}.{k}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS]))
    at = F.col(runs)
    start = F.concat(F.array(F.lit(0)), F.transform(at, lambda x: x["e"]))
    stop = F.concat(F.transform(at, lambda x: x["s"]), F.array(F.length("text")))
    kept = F.zip_with(start, stop, lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    out = found.withColumn(runs, _merged(every)).withColumn("text", F.when(F.size(at) > 0, F.array_join(kept, mask)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(at) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
