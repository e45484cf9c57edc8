"""Personal data by candidate gradient boosting, on built-in functions only.

Base spans are format matches: leftmost, non-overlapping per kind, failing ones dropped.
Beside them generous generators propose overlapping candidates: runs of digits and
separators, single groups of 13 to 19 digits, international numbers that end before other
digits follow, addresses that spell out ``(at)``, and IP numbers with bracketed dots. Format
and context features describe them.

Trees learn from labels that the base formats yield: candidates that overlap a base span are
positive, and so are ``disguises`` of every base span, i.e. what the generators and features
would make of it with its deciding sign removed (no plus sign, ``(at)``, dotted groups,
bracketed dots) in its own surroundings. All other candidates are negative. A combination of
features adds its candidates, unless they touch a base span, where the share of positives is
shown to be ``PRECISION`` at least: by a lower confidence bound over the held-out candidates of
its narrow band of probabilities or its own, never by a running total that other combinations
fill. One without a positive, or whose own counts speak against ``PRECISION``, adds nothing.

Positions are code points, ends exclusive. Null text is empty and has no spans; where no
candidate or only one class exists, as in an empty table, nothing is added. Repeated rows and
equal texts get equal spans. Long texts are taken whole, within their row. Extra columns are
ignored, and kept by ``redact`` whatever their names.

The patterns are possessive where that changes no match, so that they take linear time and
no stack on long runs.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Base formats. A start right after the last match or a character that cannot belong to it.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a kind's pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Generators of candidates, and the kinds they propose.
GENERATORS = {
    "number": (r"[+(]?[0-9][0-9\x20().\x2F-]{5,}+", ("ip", "card", "phone")),
    "group": (r"(?<![0-9])[0-9]{13,19}+(?![0-9])", ("card",)),
    "abroad": (r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9])", ("phone",)),
    "defanged": (r"[0-9]{1,3}+(?:[(\[](?:\.|dot)[)\]][0-9]{1,3}+){3}", ("ip",)),
    "spelled": (
        r"[A-Za-z0-9._%+-]++\x20?(?:@|[(\[][aA][tT][)\]])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[][dD][oO][tT][)\]])\x20?[A-Za-z0-9-]++)++",
        ("email",),
    ),
}
#: Words right before a span that speak for one.
CONTEXT = r"(?i)\b(?:tel|phone|call|mobile|fax|mail|e-mail|card|visa|account|ip|host|contact|at)\b\W*$"
PRECISION = 0.98
#: Normal quantile of the one-sided 95 % bounds, and the number of bands of probabilities.
QUANTILE, BANDS = 1.645, 100
FEATURES = ("kind_id", "digits", "groups", "style", "sign", "context", "joined", "tail")
#: Fewest and most digits of a candidate.
DIGITS = {"card": (12, 20), "phone": (7, 15), "ip": (4, 12), "email": (0, 1000)}
_SPAN = "struct<start:int,end:int,value:string>"
_DESCRIBED = "struct<kind:string,start:int,end:int,f:array<int>>"


def _spans(text: Column, pattern: str) -> Column:
    """All matches with their positions: the text between matches tells where they start."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    empty = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    return F.aggregate(pairs, empty, step, lambda acc: acc["found"])


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.when(F.regexp_replace(p, "^0+", "") == "", 0).otherwise(256)) <= 255)
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _raw(text: Column, kind: str) -> Column:
    """Matches of a base format, tried only where the text holds what the format needs."""
    wanted = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
    if kind != "email":
        wanted = text.rlike("[0-9]") & wanted
    found = F.filter(_spans(text, BASE[kind]), lambda s: _holds(kind, s["value"]))
    return F.when(wanted, found).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def _named(raw: Column, kind: str) -> Column:
    return F.transform(raw, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Base spans of all kinds as ``kind, start, end``."""
    return F.concat(*[_named(_raw(text, k), k) for k in KINDS])


def _number_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _described(text: Column, s: Column, value: Column, kind: str) -> Column:
    """Span ``s`` with the features of ``value`` in its place."""
    plain = F.regexp_replace(value, "[^0-9]", "")
    groups = F.size(F.split(F.regexp_replace(value, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+"))
    style = F.when(value.rlike(r"[(\[](?:\.|(?i)dot|at)[)\]]"), 5).when(value.rlike("[()]"), 4).when(value.contains("-"), 3).when(value.contains("."), 2)
    style = style.when(value.contains("/"), 6).when(value.contains(" "), 1).otherwise(0)
    sign = {"card": _luhn(plain), "phone": value.startswith("+"), "ip": _holds("ip", F.regexp_replace(value, r"[^0-9]+", ".")), "email": value.contains("@")}[kind]
    before = F.substring(text, F.greatest(s["start"] - 15, F.lit(1)), F.least(s["start"], F.lit(16)))
    joined = F.substring(text, F.greatest(s["start"], F.lit(1)), F.least(s["start"], F.lit(1))).rlike(r"[\p{L}0-9_=\x22]")
    tail = F.length(F.regexp_extract(value, r"([A-Za-z0-9]+)[^A-Za-z0-9]*$", 1))
    digits = F.least(F.length(plain), F.lit(20))
    if kind == "email":
        digits, groups = F.lit(0), F.size(F.split(value, r"[.)\]]"))
    features = [F.lit(KINDS.index(kind)), digits, F.least(groups, F.lit(8)), style, sign.cast("int"), before.rlike(CONTEXT).cast("int"), joined.cast("int"), F.least(tail, F.lit(8))]
    end = s["start"] + F.length(F.regexp_replace(value, r"[^A-Za-z0-9)\]]+$", ""))
    return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), end.alias("end"), F.array(*[f.cast("int") for f in features]).alias("f"))


def _candidates(text: Column, raw: Column, kind: str) -> Column:
    least, most = DIGITS[kind]
    fit = F.filter(raw, lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", "")).between(least, most))
    return F.transform(fit, lambda s: _described(text, s, s["value"], kind))


def disguises(value: Column, kind: str) -> list[Column]:
    """What a value of a base format looks like without its deciding sign; null where it has too little form left."""
    plain = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        dotted = F.regexp_replace(value, r"\.(?=[^@]*$)", " [dot] ")
        return [F.regexp_replace(value, "@", x) for x in (" (at) ", "[at]")] + [F.regexp_replace(dotted, "@", " [at] ")]
    if kind == "ip":
        return [F.regexp_replace(value, r"\.", x) for x in ("[.]", "(dot)")]
    if kind == "card":
        return [F.regexp_replace(plain, "(.{4})(?=.)", f"$1{x}") for x in ("./")]
    parted = F.when(F.size(F.split(value, "[^0-9]+")) >= 4, F.regexp_replace(value, r"^\+", ""))
    national = F.when(parted.isNotNull(), F.regexp_replace(value, r"^\+[0-9]+[^0-9]+", ""))
    return [parted, national, F.concat(F.lit("00"), parted), F.regexp_replace(parted, r"[^0-9]+", "."), F.regexp_replace(parted, r"[^0-9]+", "-")]


def _disguised(text: Column, kind: str):
    """The described disguises of a base span."""

    def made(s: Column) -> Column:
        each = [F.when(v.isNotNull(), _described(text, s, v, kind)) for v in disguises(s["value"], kind)]
        return F.filter(F.array(*each), lambda x: x.isNotNull())

    return made


def annotated(docs: DataFrame, carried: Column | None = None) -> DataFrame:
    """``doc_id``, ``row`` (what is carried), ``base`` (kind, start, end), described candidates ``cand`` and ``fakes``."""
    raw_text = F.coalesce(F.col("text"), F.lit(""))
    digit = F.col("own").rlike("[0-9]")
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    own = docs.select("doc_id", (F.lit(None).cast("int") if carried is None else carried).alias("row"), raw_text.alias("own"))
    found = [_raw(F.col("own"), k).alias(f"raw_{k}") for k in KINDS]
    for name, (pattern, _) in GENERATORS.items():
        wanted = F.contains("own", F.lit("@")) | F.col("own").rlike(r"(?i)[(\[]at[)\]]") if name == "spelled" else digit
        if name == "abroad":
            wanted &= F.contains("own", F.lit("+"))
        found.append(F.when(wanted, _spans(F.col("own"), pattern)).otherwise(none).alias(name))
    own = own.select("*", *found)
    cand = [_candidates(F.col("own"), F.col(name), k) for name, (_, kinds) in GENERATORS.items() for k in kinds]
    fakes = [F.flatten(F.transform(f"raw_{k}", _disguised(F.col("own"), k))) for k in KINDS]
    base = F.concat(*[_named(F.col(f"raw_{k}"), k) for k in KINDS])
    return own.select("doc_id", "row", base.alias("base"), F.array_distinct(F.concat(*cand)).cast(f"array<{_DESCRIBED}>").alias("cand"), F.concat(*fakes).alias("fakes"))


def _touches(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _bound(hits: Column, n: Column, side: int) -> Column:
    """Wilson bound of a share: the lower one for side -1, the upper one for side 1."""
    share, z = hits / n, QUANTILE
    return (share + z * z / (2 * n) + side * z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def accepted(table: DataFrame) -> list[list[int]]:
    """Feature combinations whose candidates are added: trees over all candidates of the table.

    Candidates are counted by feature combination first, so what is learned from and what
    comes to the driver is bounded by the ranges of the features, not by the corpus.
    """
    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0).alias("test")
    hit = lambda c: F.exists("base", lambda b: (b["kind"] == c["kind"]) & _touches(b, c))
    real = F.transform("cand", lambda c: F.struct(c["f"].alias("f"), hit(c).cast("int").alias("hit")))
    fake = F.transform("fakes", lambda c: F.struct(c["f"].alias("f"), F.lit(1).alias("hit")))
    each = table.filter((F.size("cand") > 0) | (F.size("fakes") > 0)).select(fold, F.explode(F.concat(real, fake)).alias("c"))
    combos = each.groupBy("test", F.col("c.f").alias("f")).agg(F.count("*").alias("n"), F.sum("c.hit").alias("hits"))
    combos = combos.select("test", "f", "n", "hits", *[F.col("f")[i].cast("double").alias(name) for i, name in enumerate(FEATURES)]).coalesce(1)
    combos = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(combos).persist()
    try:
        return _chosen(combos)
    finally:
        combos.unpersist()


def _chosen(combos: DataFrame) -> list[list[int]]:
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("hits").cast("double").alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("hits")).cast("double").alias("weight"))))
    fit = combos.filter("NOT test").select("features", sides.alias("s")).select("features", "s.label", "s.weight").filter("weight > 0")
    if fit.select("label").distinct().count() < 2:
        return []
    model = GBTClassifier(weightCol="weight", maxIter=10, maxDepth=3, stepSize=0.3, seed=7).fit(fit)
    scored = model.transform(combos).select("test", "f", "n", "hits", "kind_id", vector_to_array("probability")[1].alias("p"))
    scored = scored.withColumn("band", F.round(F.col("p") * BANDS))
    good = lambda *keys: scored.filter("test").groupBy(*keys).agg(F.sum("hits").alias("h"), F.sum("n").alias("m")).filter(_bound(F.col("h"), F.col("m"), -1) >= PRECISION).select(*keys)
    own = scored.groupBy("kind_id", "band", "f").agg(F.sum("hits").alias("h"), F.sum("n").alias("m"))
    fits = own.filter((F.col("h") > 0) & (_bound(F.col("h"), F.col("m"), 1) >= PRECISION))
    both = fits.join(good("kind_id", "band"), ["kind_id", "band"]).select("f").union(fits.join(good("f"), "f").select("f"))
    return sorted(list(r.f) for r in both.distinct().collect())


def spans(table: DataFrame, chosen: list[list[int]]) -> DataFrame:
    """Adds ``spans``: base spans and added ones, by kind, then start."""
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    added = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    if chosen:
        keys = F.array(*[F.lit(",".join(map(str, f))) for f in chosen])
        fits = F.filter("cand", lambda c: F.array_contains(keys, F.array_join(c["f"].cast("array<string>"), ",")) & ~F.exists("base", lambda b: _touches(b, c)))
        added = F.transform(fits, lambda c: F.struct(c["kind"], c["start"], c["end"]))
    every = F.array_distinct(F.concat("base", added))
    order = F.array_sort(F.transform(every, lambda s: F.struct(place[s["kind"]], s["start"], s["end"], s["kind"].alias("kind"))))
    return table.withColumn("spans", F.transform(order, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))


def precision(table: DataFrame, chosen: list[list[int]]) -> tuple[int, int]:
    """Positives and all among the candidates and disguises of the held-out half that have a chosen combination."""
    keys = F.array(*[F.lit(",".join(map(str, f))) for f in chosen]) if chosen else F.expr("cast(array() as array<string>)")
    fits = lambda c: F.array_contains(keys, F.array_join(c["f"].cast("array<string>"), ","))
    hit = lambda c: F.exists("base", lambda b: (b["kind"] == c["kind"]) & _touches(b, c))
    held = table.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0)
    good = F.size(F.filter("cand", lambda c: fits(c) & hit(c))) + F.size(F.filter("fakes", fits))
    every = F.size(F.filter("cand", fits)) + F.size(F.filter("fakes", fits))
    r = held.agg(F.sum(good).alias("good"), F.sum(every).alias("every")).first()
    return r.good or 0, r.every or 0


def _joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(text: Column, found: Column) -> Column:
    """``text`` with the places of ``found`` replaced by ``<kind>``; of overlapping ones the first gives its name."""
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def cut(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        more = F.struct(s["end"].alias("at"), F.concat(acc["out"], kept, F.lit("<"), s["kind"], F.lit(">")).alias("out"))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(more)

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(order, begin, cut, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by ``<kind>``; ``n_chars`` is that of the new text.

    What is cut can leave a base format behind, say the second of two numbers that were one
    run before. Such texts are cut again until none holds a base span; every time uses up a
    run of digits or an ``@``, which bounds the turns.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    table = common.Scratch(spark, "personal").save(annotated(docs, row), "annotated")
    found = spans(table, accepted(table.drop("row")))

    def again(acc: Column, _: Column) -> Column:
        left = base_spans(acc["text"])
        more = F.struct(_cut(acc["text"], left).alias("text"), (F.size(left) == 0).alias("done"))
        return F.when(acc["done"], acc).otherwise(more)

    turns = F.split(F.col("row.text"), "[^0-9@]+")
    first = F.struct(_cut(F.col("row.text"), F.col("spans")).alias("text"), F.lit(False).alias("done"))
    changed = F.size("spans") > 0
    new = F.when(changed, F.aggregate(turns, first, again, lambda acc: acc["text"])).otherwise(F.col("row.text"))
    found = found.select("row", changed.alias("changed"), new.alias("new"))
    values = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col("changed"), F.length("new").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select(*[values.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op9_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = annotated(common.documents(spark, sf_dir))
    table = common.Scratch(spark, "personal").save(table, "annotated")
    found = spans(table, accepted(table))
    return found.select("doc_id", *[_number_of(k) for k in KINDS], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
