"""Personal data: fixed patterns, and contexts bootstrapped from what they find; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import materialize

#: The kinds, in order, with their patterns. Where a pattern starts with a run of characters, it starts at the head of the run or where the last match ended, as any leftmost match does; so no run is tried from each of its places. Loops are possessive where nothing that follows could use what they give back.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth trying.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A word with a digit or an at sign.
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: A kind that no base pattern has: its seeds are long runs of hexadecimal digits with letters, and only contexts report them.
SECRET = len(KINDS)
_KEY = r"^(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}$"
#: A kind for matches that look like one and fail its test, such as a card of a wrong check digit: no context can mark them.
_REFUSED = -1
#: Characters around a token that are looked at, and matches whose places one fold works out.
_NEAR, _FOLD = 120, 512
#: Distinct seeds that a context must stand at, and share of its tokens that must be of its kind.
SUPPORT, CONFIDENCE = 3, 0.8


def _luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, "[ -]", "")

    def digit(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + digit(i))
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _shape(value: Column) -> Column:
    """Runs of letters as one a, runs of digits as one 0."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]+", "0")


def _shaped() -> Column:
    """May the token be personal data: four digits or more, or an at sign?"""
    return (F.length(F.regexp_replace("token", "[^0-9]", "")) >= 4) | F.col("token").contains("@")


def _ends(lengths: str) -> Column:
    """The running sums of an array of numbers.

    Folds of ``_FOLD`` numbers, each of which starts at the sum of those before it: a fold copies what it has built at every
    step, so one over the whole array would take time in its square.
    """
    parts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _FOLD).cast("int"))

    def part(k: Column) -> Column:
        return F.slice(lengths, k * _FOLD + 1, F.lit(_FOLD))

    def running(numbers: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(numbers, empty, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")), lambda acc: acc["out"])

    def total(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0), lambda acc, x: acc + x)

    bases = running(F.transform(parts, lambda k: total(part(k))), F.lit(0))
    return F.flatten(F.zip_with(parts, bases, lambda k, base: running(part(k), base - total(part(k)))))


def _located(df: DataFrame, name: str, pattern: str, useful: Column, around: bool = False) -> DataFrame:
    """Add ``name``: the matches of ``pattern`` in ``text``, each with start, end, value and, if ``around``, the three words before it and the two after it.

    Splitting by a pattern finds the same matches as extracting them; the lengths of both, in code points, give the places.
    Words around a match are in lower case, matches among them masked by their shape; ``^`` and ``$`` stand for those beyond
    the text. They are looked for in ``_NEAR`` characters of each piece.
    """
    kind = f"array<struct<start:int,end:int,value:string{around and ',left:array<string>,right:array<string>' or ''}>>"
    df = df.withColumn("_m", F.when(useful, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split("text", pattern, -1)))
    df = df.withColumn("_l", F.zip_with(F.slice("_p", F.lit(1), F.size("_m")), "_m", lambda p, m: F.length(p) + F.length(m)))
    df = df.withColumn("_e", F.when(F.size("_m") > 0, _ends("_l")))
    if around:
        df = df.withColumn("_s", F.transform("_m", lambda m: _shape(F.right(m, F.lit(_NEAR)))))

    def piece(i: Column, cut) -> Column:
        return F.coalesce(cut(F.get("_p", i), F.lit(_NEAR)), F.lit(""))

    def words(text: Column) -> Column:
        return F.split(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), " ")

    def match(i: Column) -> Column:
        value = F.get("_m", i)
        end = F.get("_e", i)
        more = []
        if around:
            shape = lambda j: F.coalesce(F.get("_s", j), F.lit(""))
            before = [x for k in (3, 2, 1) for x in (piece(i - k, F.right), shape(i - k))]
            after = [x for k in (1, 2, 3) for x in (piece(i + k, F.left), shape(i + k))]
            left = words(F.concat(F.lit("^ ^ ^ "), *before, piece(i, F.right)))
            right = words(F.concat(*after, F.lit(" $ $")))
            more = [F.slice(left, -3, 3).alias("left"), F.slice(right, 1, 2).alias("right")]
        return F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"), *more)

    found = F.transform(F.sequence(F.lit(0), F.size("_m") - 1), match)
    return df.withColumn(name, F.when(F.size("_m") > 0, found).otherwise(F.array().cast(kind))).drop("_m", "_p", "_l", "_e", "_s")


def _looks(kind: str, value: Column) -> Column:
    """Is a match that fails the test of ``kind`` a counterexample of it?"""
    if kind == "card":
        return F.length(F.regexp_replace(value, "[ -]", "")).between(13, 19)
    return F.lit(kind == "ip")


def _held(k: int, kind: str, refused: bool = False) -> Column:
    """The spans of the matches in column ``_kind`` that are what they look like; or if ``refused``, those that only look like it."""
    held = F.filter(f"_{kind}", lambda s: ~_holds(kind, s["value"]) & _looks(kind, s["value"]) if refused else _holds(kind, s["value"]))
    of = F.lit(_REFUSED if refused else k)
    return F.transform(held, lambda s: F.struct(of.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("h")))


def _text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, [*KINDS, "secret"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(k: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")


def base_spans(docs: DataFrame) -> DataFrame:
    """Add ``base`` and ``refused``: arrays of (kind, start, end, h), h a hash of what is there, by kind and start.

    The kind of a base span is counted from 0 in the order of ``KINDS``; refused are matches that fail the test of their kind.
    """
    text = F.col("text")
    digits = text.rlike("[0-9]")
    spans, refused = [], []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        useful = text.contains(HINTS[kind]) if kind == "email" else digits & text.contains(HINTS[kind])
        docs = _located(docs, f"_{kind}", pattern, useful)
        spans.append(_held(k, kind))
        refused.append(_held(k, kind, refused=True))
    return docs.withColumns({"base": F.concat(*spans), "refused": F.concat(*refused)}).drop(*[f"_{kind}" for kind in KINDS])


def _contexts() -> Column:
    """The contexts of a token with ``left`` and ``right``: one, two and three words before it, one and two after it, and one on either side; each with its form."""

    def words(side: str, first: int, last: int) -> Column:
        return F.array_join(F.slice(side, first, last), " ")

    forms = {"L1": [words("left", 3, 1)], "L2": [words("left", 2, 2)], "L3": [words("left", 1, 3)], "R1": [words("right", 1, 1)], "R2": [words("right", 1, 2)], "LR": [words("left", 3, 1), words("right", 1, 1)]}
    return F.array(*[F.struct(F.lit(form).alias("form"), F.concat_ws(" _ ", *parts).alias("words")) for form, parts in forms.items()])


def _patterns(edges: DataFrame) -> DataFrame:
    """Contexts worth trusting, with the kind they lead to and how sure that is: form, words, kind, confidence.

    ``edges`` (form, words, token, kind) is the graph of contexts and the tokens that stand in them; a token that holds a base
    span, or is a seed of ``SECRET``, has a kind. In each round a context's kind is the one most of its seeds have, and every
    context with enough seeds of it scores the mean of its tokens: 1 for a seed of its kind, 0 for one of another kind or a
    refused one, and for any other token the largest share of that kind among the token's other contexts of the form that
    have enough seeds, so that no context raises itself. Those that score enough are trusted from then on, and the tokens they
    mark are seeds of the next round. Rounds end when no context is added. All groups are partial aggregates.
    """
    key = ["form", "words"]
    nodes = materialize(edges.groupBy(*key, "token").agg(F.max("kind").alias("kind")))
    trusted = edges.sparkSession.createDataFrame([], "form string, words string, kind int, confidence double")
    while True:
        marked = nodes.where("kind is null").where(_shaped()).select(*key, "token").join(trusted.select(*key, "kind"), key)
        marked = marked.groupBy("token").agg(F.min("kind").alias("found"))
        known = materialize(nodes.join(marked, "token", "left").select(*key, "token", F.coalesce("kind", "found").alias("kind")))
        kinds = known.groupBy(*key, "kind").agg(F.count("*").alias("c"))
        seeds = F.when(F.col("kind") >= 0, F.struct("c", (-F.col("kind")).alias("k")))
        shares = kinds.groupBy(*key).agg(F.max(seeds).alias("major"), F.sum("c").alias("n")).where(F.col("major.c") >= SUPPORT)
        shares = shares.select(*key, (-F.col("major.k")).alias("kind"), F.col("major.c").alias("seeds"), "n")
        shares = shares.join(trusted.select(*key, "confidence"), key, "left")
        shares = materialize(shares.withColumn("share", F.coalesce("confidence", F.col("seeds") / F.col("n"))))
        unknown = known.where("kind is null").select(*key, "token")
        unknown = materialize(unknown.join(shares.select(*key, F.col("kind").alias("of"), "share"), key))
        each = ["form", "token", "of"]
        top = unknown.groupBy(*each).agg(F.max(F.struct("share", "words")).alias("top"))
        rest = unknown.join(top, each)
        second = rest.where("words <> top.words").groupBy(*each).agg(F.max("share").alias("second"))
        other = F.when(F.col("words") == F.col("top.words"), F.coalesce("second", F.lit(0.0))).otherwise(F.col("top.share"))
        lent = rest.join(second, each, "left").groupBy(*key).agg(F.sum(other).alias("lent"))
        scored = shares.where("confidence is null").drop("confidence").join(lent, key, "left")
        scored = scored.withColumn("confidence", (F.col("seeds") + F.coalesce("lent", F.lit(0.0))) / F.col("n"))
        added = materialize(scored.where(F.col("confidence") >= CONFIDENCE).select(*key, F.col("kind").cast("int").alias("kind"), "confidence"))
        if added.isEmpty():
            return trusted
        trusted = materialize(trusted.unionByName(added))


def _tokens(found: DataFrame) -> DataFrame:
    """One row for each token: doc_id, uid, left, right, token, start, length, kind (of its seed), known (does a base span hold it).

    A base span belongs to the first of its words; the others are no tokens of their own. The spans of a text are dealt over
    about as many stretches as the root of their number, so that a token is held against those near it only.
    """
    every = F.concat("base", "refused")
    width = F.greatest(F.lit(256), F.ceil(F.col("chars") / F.sqrt(F.size(every) + 1))).cast("int")
    found = found.where("size(tokens) > 0").withColumns({"_every": every, "_width": width})
    last = F.floor(F.col("chars") / F.col("_width")).cast("int")
    stretch = lambda k: F.filter("_every", lambda s: (s["start"] < (k + 1) * F.col("_width")) & (s["end"] > k * F.col("_width")))
    found = found.withColumn("_stretches", F.transform(F.sequence(F.lit(0), last), stretch))

    def seeded(t: Column) -> Column:
        first, until = (F.floor(x / F.col("_width")).cast("int") for x in (t["start"], t["end"] - 1))
        near = F.flatten(F.slice("_stretches", first + 1, until - first + 1))
        held = F.filter(near, lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"]))
        seed = F.get(F.array_sort(F.transform(held, lambda s: F.struct(s["kind"] < 0, s["start"], s["kind"], s["h"]))), F.lit(0))
        return F.struct(t.alias("t"), seed["start"].alias("at"), seed["kind"].alias("kind"), seed["h"].alias("h"))

    tokens = found.select("doc_id", "uid", F.explode(F.transform("tokens", seeded)).alias("x")).where("x.at is null or x.at >= x.t.start or x.kind < 0")
    value = F.col("x.t.value")
    core = F.regexp_extract(value, r"(?s)[\p{L}\p{N}].*[\p{L}\p{N}]", 0)
    key = F.when(F.lower(core).rlike(_KEY), SECRET)
    tokens = tokens.select(
        "doc_id",
        "uid",
        F.col("x.t.left").alias("left"),
        F.col("x.t.right").alias("right"),
        F.coalesce(F.col("x.h").cast("string"), F.lower(core)).alias("token"),
        (F.col("x.t.start") + F.length(F.regexp_extract(value, r"^[^\p{L}\p{N}]*", 0))).alias("start"),
        F.length(core).alias("length"),
        F.coalesce("x.kind", key).alias("kind"),
        F.col("x.kind").isNotNull().alias("known"),
    )
    return tokens.where("length > 0")


def find(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    The base patterns give the first counts and base_sha256; ``spans``, and their number ``n_found``, also have what
    bootstrapping adds. Base matches are seeds, and so are long hexadecimal keys: the words around them become contexts, and
    the graph of contexts and the tokens with digits or at signs that stand in them is scored in rounds (``_patterns``).
    Contexts that stand at enough seeds of one kind and hardly anything else mark tokens of four digits or more, or with an at
    sign, that no pattern knew; such a span gets the kind of its surest context, and its token is a seed of the next round. A
    key is reported as ``secret`` only where a context says so; a number that fails the test of a kind is never marked.

    Texts are read once and not shuffled; only spans and tokens are. Null and empty texts have no spans; rows that repeat are
    found alike; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = base_spans(docs.withColumns({"uid": F.xxhash64("doc_id", "text"), "chars": F.length("text")}))
    found = _located(found, "tokens", _TOKEN, F.col("text").rlike("[0-9@]"), around=True)
    found = materialize(found.select("doc_id", "uid", "chars", "base", "refused", "tokens"))

    tokens = _tokens(found)
    edges = tokens.select("token", "kind", F.explode(_contexts()).alias("c")).select("c.*", "token", "kind")
    trusted = _patterns(edges)
    new = tokens.where("not known").where(_shaped()).select("doc_id", "uid", "start", "length", F.explode(_contexts()).alias("c"))
    new = new.select("doc_id", "uid", "start", "length", "c.*").join(trusted, ["form", "words"])
    new = new.groupBy("doc_id", "uid", "start", "length").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    span = F.struct("kind", "start", (F.col("start") + F.col("length")).alias("end"))
    added = new.groupBy(F.col("doc_id").alias("_doc_id"), F.col("uid").alias("_uid")).agg(F.collect_set(span).alias("added"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("uid") == F.col("_uid"))
    whole = found.drop("tokens", "refused").join(added, same, "left")
    placed = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    every = F.array_sort(F.concat(placed, F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    return whole.select(
        "doc_id",
        *[_count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
        _text(every).alias("spans"),
        F.size(every).cast("long").alias("n_found"),
    )
