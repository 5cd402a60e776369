"""Secret scans: fixed patterns plus a battery of randomness tests, in built-in functions alone.

Three patterns give the base spans. Besides them, every run of 20 or more token characters whose
characters name an encoding (hex, base-32, base-36, base-62, base-64) is tested. The null is ordinary
token text: letters by their usual frequencies, capitals and digits in groups, vowels between
consonants. A p-value says how often ordinary text would look as random as the run does:

* chi-squared uniformity of the encoding's alphabet: the sum of squared counts against its mean and exact
  variance for ordinary frequencies of that alphabet, lower tail;
* runs: changes between small letters, capitals and digits, but for a capital at a word's start, against
  CHANGES a character, upper tail;
* serial correlation of vowels at lag one, against that of words, -ALTERNATION, upper tail.

Fisher's method joins the three. Runs that ordinary text would hardly give are secrets, by the
Benjamini-Hochberg procedure, class of length by class of length, so that short runs with weak
tests and long ones with strong tests each keep the rate of false secrets. The procedure's cut needs
only counts of p-values per length class and bin (classes x 400 rows), taken over the whole input
outside the base spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, once, running

# The base patterns.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
# Letters in a thousand of English text, a to z.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: Of ordinary token text: small letters, capitals, digits and signs in a hundred.
SHARES = (80, 8, 10, 2)
CHANGES, ALTERNATION = 0.25, 0.3
CHANGE = "(?<=[a-z])[A-Z0-9]|(?<=[0-9])[A-Za-z]|(?<=[A-Z])[0-9]"
FALSE_DISCOVERY = 0.05
BINS_PER_DECADE, N_BINS = 20, 400
SPANS = "array<struct<s:int,e:int,k:int>>"
REDACTED = "[REDACTED]"
#: Characters of a block in which redaction looks for a place.
BLOCK = 512


def _spans(text: Column, pattern: str, kind: int, least: int | None = None) -> Column:
    """Sorted spans of a pattern's matches (code points); with least, of those whose second group has so many characters."""
    length = lambda found: F.transform(found, F.length)
    # each match with the text before it; the text after the last one has no match
    parts = [length(F.split(text, pattern)).alias("gap"), length(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("n")]
    if least is not None:
        parts.append(length(F.regexp_extract_all(text, F.lit(pattern), F.lit(2))).alias("own"))
    found = F.filter(F.arrays_zip(*parts), lambda x: x["n"].isNotNull())

    def placed(xs: Column) -> Column:
        starts = running(F.transform(xs, lambda x: x["gap"] + x["n"]))
        every = F.zip_with(xs, starts, lambda x, at: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + x["n"]).alias("e"), F.lit(kind).alias("k"), (x["own"] if least else x["n"]).alias("own")))
        long = F.filter(every, lambda x: x["own"] >= least) if least else every
        return F.transform(long, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))

    return F.when(F.rlike(text, F.lit(pattern)), once(found, placed).cast(SPANS)).otherwise(F.array().cast(SPANS))


def _normal_tail(z: Column) -> Column:
    """P(Z > z), to about 1e-4 (the logistic approximation with a cubic term)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-600.0), F.least(F.lit(600.0), 1.5976 * z + 0.070565 * z * z * z))))


def ordinary(letters: str) -> tuple[float, float]:
    """Sums of squares and of cubes of the frequencies that an alphabet's symbols have in ordinary token text."""
    small, capital, digit, sign = SHARES
    capital = capital if set(letters) & set(LOWER) else small
    weight = {c: small * n / sum(LETTERS) for c, n in zip(LOWER, LETTERS, strict=True)} | {c: capital * n / sum(LETTERS) for c, n in zip(UPPER, LETTERS, strict=True)}
    weight |= {c: digit / 10 for c in DIGITS} | {c: sign / 4 for c in "+/_-"}
    q = [weight[c] / sum(weight[x] for x in letters) for c in letters]
    return sum(x**2 for x in q), sum(x**3 for x in q)


def _random_tokens(text: Column) -> Column:
    """array<struct<s, e, c, p>>: candidate runs, their length classes and the p-value of the battery."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    spans = _spans(text, CANDIDATE, 3)

    def named(t: Column) -> Column:
        """struct<abc, two, three> of the encoding; null for numbers."""
        out = F.when(~F.rlike(t, F.lit("[A-Za-z]")), F.lit(None))
        for pattern, letters in ENCODINGS:
            two, three = ordinary(letters)
            out = out.when(F.rlike(t, F.lit(pattern)), F.struct(F.lit(letters).alias("abc"), F.lit(two).alias("two"), F.lit(three).alias("three")))
        return out

    one = F.transform(
        F.arrays_zip(spans.alias("span"), F.transform(found, lambda t: F.regexp_replace(t, "=+$", "")).alias("t")),
        lambda x: F.struct(x["span"]["s"].alias("s"), x["span"]["e"].alias("e"), x["t"].alias("t"), named(x["t"]).alias("enc")),
    )
    one = F.filter(one, lambda x: x["enc"].isNotNull())

    def p_value(x: Column) -> Column:
        t, n = x["t"], F.length(x["t"]).cast("double")
        two, three = x["enc"]["two"], x["enc"]["three"]
        times = lambda c: (n - F.length(F.replace(t, c, F.lit("")))).cast("double")
        squares = F.aggregate(F.split(x["enc"]["abc"], ""), F.lit(0.0), lambda acc, c: acc + times(c) * times(c))
        n2, n3, n4 = n * (n - 1), n * (n - 1) * (n - 2), n * (n - 1) * (n - 2) * (n - 3)
        spread = F.sqrt(n4 * two * two + 4 * n3 * three + 2 * n2 * two - n2 * n2 * two * two)
        even = _normal_tail((n + n2 * two - squares) / spread)
        # signs only part words
        body = F.regexp_replace(t, "[+/_-]", "")
        m = F.greatest(F.lit(2.0), F.length(body).cast("double"))
        changes = F.regexp_count(body, F.lit(CHANGE))
        mixed = _normal_tail((changes - 0.5 - (m - 1) * CHANGES) / F.sqrt((m - 1) * CHANGES * (1 - CHANGES)))
        share = F.regexp_count(body, F.lit("[AEIOUaeiou]")) / m
        pairs = F.regexp_count(body, F.lit("[AEIOUaeiou](?=[AEIOUaeiou])")) / (m - 1)
        serial = F.when((share > 0) & (share < 1), (pairs - share * share) / (share * (1 - share))).otherwise(F.lit(0.0))
        loose = _normal_tail((serial + ALTERNATION) * F.sqrt(m))
        stat = F.lit(0.0)
        for p in (even, mixed, loose):
            stat = stat - F.ln(F.least(F.lit(1.0), F.greatest(F.lit(1e-280), p)))
        # twice stat is chi-squared with 6 degrees of freedom
        return F.exp(-stat) * (1 + stat + stat * stat / 2)

    return F.transform(
        one, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.floor(F.log2(F.length(x["t"]).cast("double"))).cast("int").alias("c"), p_value(x).alias("p"))
    )


def _text(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _base(text: Column) -> Column:
    return F.concat(_spans(text, ASSIGN, 0, 6), _spans(text, ACCESS, 1), _spans(text, HEX, 2))


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span: of the spans that start before a token's end, found by halving, none reaches beyond its start."""

    def free(spans: Column) -> Column:
        starts = F.transform(spans, lambda y: y["s"])
        reach = running(F.concat(F.transform(spans, lambda y: y["e"]), F.array(F.lit(0))), F.greatest)
        n = F.size(spans)
        halves = F.transform(F.sequence(F.ceil(F.log2(n + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))

        def apart(x: Column, s: Column, r: Column, h: Column) -> Column:
            before = F.aggregate(h, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(s, at + step - 1) < x["e"]), at + step).otherwise(at))
            return F.get(r, before) <= x["s"]

        return once(starts, lambda s: once(reach, lambda r: once(halves, lambda h: F.filter(tokens, lambda x: apart(x, s, r, h)))))

    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(once(F.array_sort(base), free))


def rejection_cuts(docs: DataFrame, q: float = FALSE_DISCOVERY) -> dict[int, float]:
    """The largest p-value of each length class that names a secret. At most 32 classes come to the driver."""
    rows = docs.where(F.rlike(F.col("text"), F.lit(CANDIDATE))).select(_random_tokens(F.col("text")).alias("t"), _base(F.col("text")).alias("base"))
    tokens = rows.select(F.explode(_apart(F.col("t"), F.col("base"))).alias("t"))
    bins = tokens.groupBy(
        F.col("t.c").alias("c"), F.least(F.lit(N_BINS), F.floor(-F.log10(F.greatest(F.lit(1e-280), F.col("t.p"))) * BINS_PER_DECADE)).alias("b")
    ).agg(F.count("*").alias("n"))
    up = Window.partitionBy("c").orderBy(F.desc("b"))
    sums = bins.withColumn("below", F.sum("n").over(up)).withColumn("m", F.sum("n").over(Window.partitionBy("c")))
    edge = F.pow(F.lit(10.0), -F.col("b") / BINS_PER_DECADE)
    cuts = sums.where(edge <= q * F.col("below") / F.col("m")).groupBy("c").agg(F.max(edge).alias("cut"))
    return {r["c"]: r["cut"] for r in cuts.collect()}


def with_spans(docs: DataFrame, q: float = FALSE_DISCOVERY, name: str = "spans") -> DataFrame:
    """docs plus a column of array<struct<s, e, k>>: all spans by start, end (exclusive) and kind.

    Kinds are numbered as in KINDS. A span of the method that overlaps a base span isn't repeated.
    """
    text = _text(docs)
    cuts = rejection_cuts(docs, q)
    table = F.create_map(*[F.lit(x) for kv in sorted(cuts.items() or {0: -1.0}.items()) for x in kv])
    cut = lambda c: F.coalesce(F.try_element_at(table, c), F.lit(-1.0))
    tokens = F.when(F.rlike(text, F.lit(CANDIDATE)), F.filter(_random_tokens(text), lambda t: t["p"] <= cut(t["c"])))
    b, t = fresh(docs, "base_spans"), fresh(docs, "random_tokens")
    out = docs.withColumn(b, _base(text)).withColumn(t, F.coalesce(tokens, F.array()))
    extra = F.transform(_apart(F.col(t), F.col(b)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(3).alias("k"))).cast(SPANS)
    order = lambda x: F.array_sort(F.transform(x, lambda y: F.struct(y["s"].alias("s"), y["k"].alias("k"), y["e"].alias("e"))))
    every = F.transform(order(F.concat(b, extra)), lambda y: F.struct(y["s"].alias("s"), y["e"].alias("e"), y["k"].alias("k")))
    return out.withColumn(name, every).drop(b, t)


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_scan(docs: DataFrame, q: float = FALSE_DISCOVERY) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Null or empty text: no spans (the hash of the empty string). Rows are judged one by one, so
    repeated rows repeat. Spans of different kinds may overlap. Empty table: no rows.
    """
    out = with_spans(docs.select("doc_id", "text"), q, "found")
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"),
        F.sha2(_joined(F.filter("found", lambda x: x["k"] < 3)), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, q: float = FALSE_DISCOVERY, mark: str = REDACTED) -> DataFrame:
    """docs with every span of ``text`` replaced by ``mark``; all rows and columns stay."""
    name = fresh(docs, "secret_spans")
    out = with_spans(docs, q, name)
    found, end = F.col(name), F.length("text")
    # a place in a long text is looked for from its block on, not from the start
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def cut(bs: Column, s: Column, e: Column) -> Column:
        first = F.floor(s / BLOCK).cast("int")
        near = F.array_join(F.slice(bs, first + 1, F.floor(e / BLOCK).cast("int") - first + 1), "")
        return F.substring(near, s - first * BLOCK + 1, F.greatest(F.lit(0), e - s))

    def left(bs: Column) -> Column:
        gaps = F.zip_with(found, running(F.transform(found, lambda x: x["e"]), F.greatest), lambda x, at: F.struct(at.alias("s"), x["s"].alias("e")))
        pieces = F.transform(F.filter(gaps, lambda g: g["e"] >= g["s"]), lambda g: cut(bs, g["s"], g["e"]))
        return F.array_join(F.concat(pieces, F.array(cut(bs, F.array_max(F.transform(found, lambda x: x["e"])), end))), mark)

    text = F.when(F.size(name) > 0, once(blocks, left)).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*[f"`{c}`" for c in docs.columns])


def op6_secrets(spark, sf_dir):
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_random")


def _sql() -> str:
    """Spans from the gaps between matches, the battery by counts of characters, and the cuts over all tokens outside the base spans."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    gaps = lambda pattern: f"[length(x) for x in string_split_regex(text, {quoted(pattern)})]"
    every = lambda pattern, group=0: f"regexp_extract_all(text, {quoted(pattern)}, {group})"
    at = "list_sum(gap[1:i])::bigint + coalesce(list_sum([length(x) for x in found[1:i - 1]]), 0)::bigint"

    def spans(kind: int, pattern: str, least: int | None = None) -> str:
        own = f"length(own[i]) >= {least}" if least else "true"
        return f"select r, {kind} as k, {at} as s, {at} + length(found[i]) as e from (select r, {gaps(pattern)} as gap, {every(pattern)} as found, {every(pattern, 2 if least else 0)} as own from d) q, unnest(range(1, len(found) + 1)) as u(i) where {own}"

    cases = " ".join(f"when regexp_matches(t, {quoted(pattern)}) then {{'abc': {quoted(letters)}, 'two': {ordinary(letters)[0]!r}::double, 'three': {ordinary(letters)[1]!r}::double}}" for pattern, letters in ENCODINGS)
    tail = lambda z: f"1.0::double / (1.0::double + exp(greatest(-600.0::double, least(600.0::double, 1.5976::double * ({z}) + 0.070565::double * ({z}) * ({z}) * ({z})))))"
    name = "case k " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(KINDS)) + " end"
    listed = f"string_agg({name} || ':' || s || ':' || e, ',' order by s, k, e)"
    classes = f"translate(body, {quoted(LOWER + UPPER + DIGITS)}, {quoted('l' * 26 + 'u' * 26 + 'd' * 10)})"
    return f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
  bs as ({spans(0, ASSIGN, 6)} union all {spans(1, ACCESS)} union all {spans(2, HEX)}),
  tk as (select r, s, e, regexp_replace(substr(text, s + 1, e - s), '=+$', '') as t from ({spans(3, CANDIDATE)}) q join d using (r)),
  en as (select *, length(t)::double as n, case when not regexp_matches(t, '[A-Za-z]') then null {cases} end as enc from tk),
  bd as (select *, regexp_replace(t, '[+/_-]', '', 'g') as body, n * (n - 1) as n2, n * (n - 1) * (n - 2) as n3, n * (n - 1) * (n - 2) * (n - 3) as n4, list_sum([pow(n - length(replace(t, c, '')), 2) for c in string_split(enc.abc, '')]) as squares from en where enc is not null),
  cl as (select *, {classes} as cls, greatest(2.0, length(body)) as m, translate(lower(body), 'eiou', 'aaaa') as vow from bd),
  ct as (select *, len([i for i in range(1, length(cls)) if substr(cls, i, 2) in ('lu', 'ld', 'dl', 'du', 'ud')]) as changes, (length(vow) - length(replace(vow, 'a', ''))) / m as share, len([i for i in range(1, length(vow)) if substr(vow, i, 2) = 'aa']) / (m - 1) as pairs from cl),
  ps as (select r, s, e, floor(log2(n))::int as c, {tail('(n + n2 * enc.two - squares) / sqrt(n4 * enc.two * enc.two + 4 * n3 * enc.three + 2 * n2 * enc.two - n2 * n2 * enc.two * enc.two)')} as p1,
    {tail(f'(changes - 0.5 - (m - 1) * {CHANGES}::double) / sqrt((m - 1) * {CHANGES}::double * (1 - {CHANGES}::double))')} as p2, {tail(f'((case when share > 0 and share < 1 then (pairs - share * share) / (share * (1 - share)) else 0.0 end) + {ALTERNATION}::double) * sqrt(m)')} as p3 from ct),
  st as (select r, s, e, c, -(ln(least(1.0, greatest(1e-280, p1))) + ln(least(1.0, greatest(1e-280, p2))) + ln(least(1.0, greatest(1e-280, p3)))) as stat from ps),
  pv as (select r, s, e, c, exp(-stat) * (1 + stat + stat * stat / 2) as p from st where not exists (select 1 from bs where bs.r = st.r and bs.s < st.e and st.s < bs.e)),
  bn as (select c, least({N_BINS}, floor(-log10(greatest(1e-280, p)) * {BINS_PER_DECADE})) as b, count(*) as n from pv group by 1, 2), sm as (select c, pow(10.0, -b / {BINS_PER_DECADE}.0) as edge, sum(n) over (partition by c order by b desc) as below, sum(n) over (partition by c) as m from bn),
  cu as (select c, max(edge) as cut from sm where edge <= {FALSE_DISCOVERY} * below / m group by 1), al as (select r, s, k, e from bs union all select r, s, 3, e from pv join cu using (c) where p <= cut),
  ag as (select r, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex, {listed} filter (k < 3) as base, {listed} as spans from al group by 1)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join ag using (r)"""


OP6_SQL = _sql()
