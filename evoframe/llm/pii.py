"""Personal data by weak supervision, in DataFrame expressions only.

Base spans come from fixed patterns with checks. Further candidates (long
identifiers that mix letters and digits, national-id shapes) get votes from regex,
gazetteer and context labelers. Their vote patterns are counted over the whole
corpus; expectation-maximisation (Dawid and Skene, 1979) over that bounded table
estimates each labeler's reliability; the posteriors then train a logistic span
classifier over discrete features, again from counts, and the classifier's verdict
adds spans. Base spans stay as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.llm.common import id_text

#: Patterns of base spans and of candidates. Possessive quantifiers and look-behinds only
#: keep matching linear; they match what the plain forms match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+"
NATIONAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "national_id")
KINDS = BASE_KINDS + ADDED_KINDS

#: Words that announce an identifier, for the gazetteer labeler.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "bearer", "credential", "credentials")
NATIONAL_WORDS = ("ssn", "social", "security", "national", "id", "identity", "tax", "taxpayer", "nino", "dni")
CONTEXT_CHARS = 40
MIN_PROBABILITY = 0.5
_CHUNK = 512
_CHUNK_CHARS = 2048


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def chunked(text: Column) -> Column:
    """A text in order in pieces of _CHUNK_CHARS code points, so that a place in it is near a piece's beginning."""
    return F.when(F.length(text) <= _CHUNK_CHARS, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK_CHARS}}}+"), F.lit(0)))


def part(chunks: Column, low: Column, high: Column) -> Column:
    """Code points ``low`` to ``high`` - 1 of a chunked text, as far as it goes."""
    k, last = (F.floor(x / _CHUNK_CHARS).cast("int") for x in (low, high))
    piece = lambda i, at, n: F.coalesce(F.substring(F.get(chunks, i), at, n), F.lit(""))
    at = (low - k * _CHUNK_CHARS + 1).cast("int")
    inner = F.array_join(F.slice(chunks, k + 2, F.greatest(last - k - 1, F.lit(0))), "")
    across = F.concat(piece(k, at, F.lit(_CHUNK_CHARS)), inner, piece(last, F.lit(1), (high - last * _CHUNK_CHARS).cast("int")))
    return F.when(k == last, piece(k, at, (high - low).cast("int"))).otherwise(across)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start,end,hit>>: leftmost non-overlapping matches, in code points.

    Matches and the text between them come from the same left-to-right search; their
    lengths add up to positions, in chunks so that many matches stay affordable.
    """

    def place(both: Column) -> Column:
        gaps = F.transform(both["between"], lambda x: F.length(x).cast("long"))
        widths = F.transform(both["hits"], lambda x: F.length(x).cast("long"))
        return bind(F.struct(gaps.alias("gaps"), widths.alias("widths"), both["hits"].alias("hits")), add_up)

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)

    def add_up(x: Column) -> Column:
        steps = F.zip_with(x["gaps"], x["widths"], lambda g, w: g + F.coalesce(w, F.lit(0)))
        chunks = bind(steps, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _CHUNK).cast("int")), lambda k: total(F.slice(s, k * _CHUNK + 1, F.lit(_CHUNK)))))
        held = F.struct(steps.alias("steps"), chunks.alias("chunks"))

        def spans(h: Column) -> Column:
            def before(i: Column) -> Column:
                k = F.floor(i / _CHUNK).cast("int")
                return total(F.slice(h["chunks"], F.lit(1), k)) + total(F.slice(h["steps"], k * _CHUNK + 1, i - k * _CHUNK))

            def one(hit: Column, i: Column) -> Column:
                start = before(i) + F.get(x["gaps"], i)
                return F.struct(start.alias("start"), (start + F.get(x["widths"], i)).alias("end"), hit.alias("hit"))

            return F.transform(x["hits"], one)

        return bind(held, spans)

    both = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return bind(both, lambda b: F.when(F.size(b["hits"]) > 0, place(b)).otherwise(_no_spans()))


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether digits pass the Luhn check: every second from the right doubled, its digits added."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = "0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return hit.rlike(f"^{part}(?:\\.{part}){{3}}$")
    if kind == "card":
        return bind(_digits(hit), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _kind_spans(kind: str, text: Column, pattern: str, needs: Column) -> Column:
    """array<struct<start,ord,end,kind>> of one base kind; texts without ``needs`` are not searched."""
    found = F.filter(located(text, pattern), lambda s: _valid(kind, s["hit"]))
    shaped = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(needs, shaped).otherwise(F.array().cast(_SPANS))


_SPANS = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"


def base_spans(text: Column) -> Column:
    """All base spans, by start, then kind in the order of BASE_KINDS."""
    digits = text.rlike("[0-9]")
    email = _kind_spans("email", text, EMAIL, text.contains("@"))
    ip = _kind_spans("ip", text, IP, digits & text.contains("."))
    card = _kind_spans("card", text, CARD, digits)
    phone = _kind_spans("phone", text, PHONE, digits & text.contains("+"))
    return F.array_sort(F.concat(email.cast(_SPANS), ip.cast(_SPANS), card.cast(_SPANS), phone.cast(_SPANS)))


def _candidates(text: Column) -> Column:
    """array<struct<start,end,hit,kind,before,after>> of added kinds, with the text around them."""

    def shaped(kind: str, pattern: str) -> Column:
        def around(found: Column, chunks: Column) -> Column:
            def one(s: Column) -> Column:
                before = part(chunks, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)), s["start"])
                after = part(chunks, s["end"], s["end"] + 2)
                return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), F.lit(kind).alias("kind"), before.alias("before"), after.alias("after"))

            return F.transform(found, one)

        return bind(located(text, pattern), lambda found: F.when(F.size(found) > 0, bind(chunked(text), lambda c: around(found, c).cast(shape))).otherwise(F.array().cast(shape)))

    shape = "array<struct<start:bigint,end:bigint,hit:string,kind:string,before:string,after:string>>"
    found = F.concat(shaped("secret", SECRET), shaped("national_id", NATIONAL))
    return F.when(text.rlike("[0-9]"), found).otherwise(F.array().cast(shape))


# ------------------------------------------------------------ labelers: 1 personal, 0 abstain, -1 not


def labelers() -> dict[str, Column]:
    hit, before, secret = F.col("c.hit"), F.lower(F.col("c.before")), F.col("c.kind") == "secret"
    words = F.split(F.trim(F.regexp_replace(before, "[^a-z_]+", " ")), " ")
    near = F.slice(F.reverse(words), 1, 3)
    known = F.when(secret, F.array(*map(F.lit, SECRET_WORDS))).otherwise(F.array(*map(F.lit, NATIONAL_WORDS)))
    vote = lambda yes, no=None: F.when(yes, 1).when(F.lit(False) if no is None else no, -1).otherwise(0)
    digit_share = F.length(_digits(hit)) / F.length(hit)
    return {
        "regex_shape": vote(F.when(secret, hit.rlike("^(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|(?:AKIA|ghp_|sk-|xox)[A-Za-z0-9_-]+)$")).otherwise(~hit.rlike("^(?:000|666|9)")), F.when(secret, hit.rlike("[A-Za-z]{12,}|^[0-9]+[A-Za-z]{1,3}$"))),
        "gazetteer_word": vote(F.arrays_overlap(near, known)),
        "context_assigned": vote(before.rlike("[=:]\\s*[\"']?$"), before.rlike("(?:/|www\\.|\\bv)$")),
        "context_quoted": vote(before.rlike("[\"']$") & F.col("c.after").rlike("^[\"']")),
        "regex_mixture": vote(F.when(secret, digit_share.between(0.25, 0.85)).otherwise(F.lit(None).cast("boolean")), secret & (digit_share < 0.1)),
    }


@dataclass(frozen=True)
class Reliability:
    """Rates at which a labeler votes for and against, on personal and on other spans."""

    yes: tuple[float, float]
    no: tuple[float, float]


def estimate(patterns: dict[tuple[int, ...], int], labeler_count: int, rounds: int = 60, prior: float = 0.5) -> tuple[list[Reliability], dict[tuple[int, ...], float]]:
    """Reliabilities and the posterior of each vote pattern, by expectation-maximisation.

    It starts from the majority of votes, which fixes which class is which; rates are
    smoothed by one pseudo-vote each. No patterns give the starting rates.
    """
    posterior = {v: 1 / (1 + math.exp(-2.0 * sum(v))) for v in patterns}
    found: list[Reliability] = [Reliability((0.6, 0.1), (0.1, 0.6)) for _ in range(labeler_count)]
    for _ in range(rounds if patterns else 0):
        mass = [sum(n * posterior[v] for v, n in patterns.items()), sum(n * (1 - posterior[v]) for v, n in patterns.items())]
        prior = (mass[0] + 1) / (mass[0] + mass[1] + 2)
        rate = lambda j, vote, side: (1 + sum(n * (posterior[v] if side == 0 else 1 - posterior[v]) for v, n in patterns.items() if v[j] == vote)) / (mass[side] + 3)
        found = [Reliability((rate(j, 1, 0), rate(j, 1, 1)), (rate(j, -1, 0), rate(j, -1, 1))) for j in range(labeler_count)]
        for v in patterns:
            odds = math.log(prior / (1 - prior))
            for j, vote in enumerate(v):
                for_, against = {1: found[j].yes, -1: found[j].no, 0: tuple(1 - a - b for a, b in zip(found[j].yes, found[j].no))}[vote]
                odds += math.log(max(for_, 1e-9) / max(against, 1e-9))
            posterior[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return found, posterior


def span_features(c: Column) -> list[Column]:
    """Discrete features of a candidate, each 0 or 1."""
    hit, before = c["hit"], c["before"]
    n = F.length(hit)
    share = F.length(_digits(hit)) / n
    tests = [c["kind"] == "national_id", n >= 32, share >= 0.25, share >= 0.6, hit.rlike("^[0-9a-fA-F-]+$"), hit.rlike("[_-]"), before.rlike("[\"'=:]\\s*[\"']?$"), hit.rlike("[A-Za-z]{8,}")]
    return [F.coalesce(t, F.lit(False)).cast("int") for t in tests]


def train(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 400, l2: float = 1.0) -> list[float]:
    """Logistic weights, bias last, from (features, weight, share of it that is personal), by damped gradient steps."""
    width = len(rows[0][0]) if rows else 0
    weights, total = [0.0] * (width + 1), sum(n for _, n, _ in rows) or 1.0
    for _ in range(rounds):
        slope = [l2 * w / total for w in weights]
        for x, n, share in rows:
            z = weights[-1] + sum(w for w, on in zip(weights, x) if on)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - share) * n / total
            for k, on in enumerate((*x, 1)):
                slope[k] += error * on
        weights = [w - 2.0 * g for w, g in zip(weights, slope)]
    return weights


def all_spans(text: Column, weights: list[float] | None, base: Column | None = None) -> Column:
    """Base spans and the candidates the classifier accepts, by start, then kind; without weights the base only."""
    base = base_spans(text) if base is None else base
    if weights is None:
        return base
    order = F.create_map(*[x for kind in ADDED_KINDS for x in (F.lit(kind), F.lit(KINDS.index(kind)))])

    def likely(c: Column) -> Column:
        score = F.lit(weights[-1])
        for value, w in zip(span_features(c), weights):
            score = score + value * F.lit(w)
        return score >= math.log(MIN_PROBABILITY / (1 - MIN_PROBABILITY))

    def joined(held: Column) -> Column:
        def with_added(found: Column) -> Column:
            added = F.transform(_clear_of(found, held), lambda c: F.struct(c["start"].alias("start"), order[c["kind"]].alias("ord"), c["end"].alias("end"), c["kind"].alias("kind")))
            return F.array_sort(F.concat(held, added.cast(_SPANS)))

        return bind(F.filter(_candidates(text), likely), lambda found: F.when(F.size(found) > 0, with_added(found)).otherwise(held))

    return bind(base, joined)


def _clear_of(found: Column, held: Column) -> Column:
    """Candidates that overlap none of the spans in ``held``, which are in order; chunks of them are asked first."""
    own = lambda k: F.slice(held, k * _CHUNK + 1, F.lit(_CHUNK))
    reach = lambda k: F.struct(k.alias("k"), F.get(held, k * _CHUNK)["start"].alias("low"), F.array_max(F.transform(own(k), lambda x: x["end"])).alias("high"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / _CHUNK).cast("int")), reach)

    def clear(c: Column, bounds: Column) -> Column:
        meets = lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])
        return ~F.exists(bounds, lambda b: (b["low"] < c["end"]) & (c["start"] < b["high"]) & F.exists(own(b["k"]), meets))

    return F.when(F.size(held) > 0, bind(chunks, lambda bounds: F.filter(found, lambda c: clear(c, bounds)))).otherwise(found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, base (the base spans) and spans (base and added), one row per document.

    Spans are array<struct<start,ord,end,kind>> in code points, end exclusive. Null and
    empty texts have none. Repeated rows are searched each; other columns are ignored; no
    rows give no rows. A candidate that overlaps a base span adds nothing.
    """
    rows = id_text(docs)
    weights = _classifier(rows)
    rows = rows.withColumn("base", base_spans(F.col("text")))
    return rows.withColumn("spans", all_spans(F.col("text"), weights, F.col("base")))


def _classifier(rows: DataFrame) -> list[float] | None:
    """Weights learnt from every candidate of the corpus; None without candidates."""
    found = rows.select(F.explode(_candidates(F.col("text"))).alias("c"))
    names = list(labelers())
    votes = [v.cast("int").alias(k) for k, v in labelers().items()]
    marks = [f.alias(f"f{k}") for k, f in enumerate(span_features(F.col("c")))]
    # At most 3 to the labelers times 2 to the features rows, whatever the corpus.
    table = found.select(*votes, *marks).groupBy(*names, *[f"f{k}" for k in range(len(marks))]).count().collect()
    if not table:
        return None
    patterns: dict[tuple[int, ...], int] = {}
    for r in table:
        v = tuple(r[n] for n in names)
        patterns[v] = patterns.get(v, 0) + r["count"]
    _, posterior = estimate(patterns, len(names))
    return train([(tuple(r[f"f{k}"] for k in range(len(marks))), float(r["count"]), posterior[tuple(r[n] for n in names)]) for r in table])


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, SHA-256 of the base spans, and all spans as text, from find()."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one.

    ``spans`` are in order. Each gives one piece, from the furthest end before it on, and
    the pieces are joined once.
    """
    tops = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _CHUNK).cast("int")), lambda k: F.array_max(F.transform(F.slice(spans, k * _CHUNK + 1, F.lit(_CHUNK)), lambda s: s["end"])))

    def joined(held: Column) -> Column:
        def reached(i: Column) -> Column:
            k = F.floor(i / _CHUNK).cast("int")
            near = F.transform(F.slice(spans, k * _CHUNK + 1, i - k * _CHUNK), lambda s: s["end"])
            return F.greatest(F.lit(0).cast("long"), F.array_max(F.slice(held["tops"], F.lit(1), k)), F.array_max(near))

        placed = F.transform(spans, lambda s, i: F.struct(reached(i).alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))
        first = F.filter(placed, lambda p: p["start"] >= p["at"])
        pieces = F.transform(first, lambda p: F.concat(part(held["chunks"], p["at"], p["start"]), F.lit("["), F.upper(p["kind"]), F.lit("]")))
        end = F.array_max(held["tops"])
        return F.concat(F.array_join(pieces, ""), part(held["chunks"], end, F.greatest(end, F.length(text).cast("long"))))

    return F.when(F.size(spans) > 0, bind(F.struct(tops.alias("tops"), chunked(text).alias("chunks")), joined)).otherwise(text)


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in text; n_chars, if there is one, is the new length.

    Null texts stay null, and so does their n_chars; empty texts stay empty. Repeated rows
    are masked each, other columns stay as they are, no rows give no rows. The time a
    text takes grows with its length and its spans, not with their product.
    """
    weights = _classifier(id_text(docs))
    text = F.coalesce(docs["text"], F.lit(""))
    clean = bind(text, lambda t: bind(all_spans(t, weights), lambda s: masked(t, s)))
    out = docs.withColumn("text", F.when(docs["text"].isNotNull(), clean))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
