"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that they miss.

Only DataFrame and SQL functions. Base spans come from Java patterns that accept the stated matches;
possessive repeats and look-behinds only keep very long runs from being scanned again and again.

Bootstrapping: base entities are the seeds. The words around a seed (one or two to the left, one to the
right, without digits or @) are lexical patterns; tokens with digits or an @, and runs of groups of
digits, that no base span covers are candidates. Edges join patterns with the surfaces they surround.
Each round scores patterns, by the share of their surfaces that is known to be of a kind, and then
candidates, by the noisy-or of the patterns of confidence MIN_CONFIDENCE and MIN_SEEDS distinct known
surfaces; candidates beyond it, of a shape that fits the kind, are known from then on. Rounds end when
one makes nothing new known; what is known only grows, so they do end. All occurrences of what is known
become spans.

Null or empty text has no spans. Rows are told apart by a number of their own, so rows that repeat a
doc_id, or have none, get the spans of their own text; contexts count distinct surfaces, so copies don't
strengthen a pattern. Very long texts and words are taken whole, in time in proportion to their length.
An empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

KINDS = ("email", "ip", "card", "phone")
MIN_CONFIDENCE, MIN_SEEDS = 0.8, 5
#: Matches of a text whose places are summed up at a time.
RUN = 256
# fixed values: the patterns of the contract, and of tokens that may be identifiers
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
TOKEN = r"(?<![^\x20\x09-\x0D])(?:[+(]?[0-9][0-9().-]*+(?:\x20\(?[0-9][0-9().-]*+)++(?![^\x20\x09-\x0D.,;:!?])|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
SHAPE = {"email": r"^[^@]+@[^@]+$", "ip": r"^[0-9A-Fa-f]+(?:[.:-][0-9A-Fa-f]+){3,7}$", "card": r"^(?:[^0-9]*[0-9]){12,19}[^0-9]*$", "phone": r"^(?:[^0-9]*[0-9]){7,15}[^0-9]*$"}
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
SPAN = "array<struct<start:int,end:int,surface:string,before:string,after:string>>"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once: what a lambda only names would be worked out again for each element."""
    return F.transform(F.array(x), f)[0]


def _runs(items: Column) -> Column:
    """Slices of RUN elements of an array that isn't empty."""
    return let(items, lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUN).cast("int")), lambda k: F.slice(a, k * RUN + 1, RUN)))


def matches(text: Column, pattern: str, gate: str) -> Column:
    """array<struct<start, end, surface, before, after>> of the leftmost non-overlapping matches, in code points; before and after are what lies between it and the matches next to it."""

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        new = F.array(F.struct(begin.alias("start"), end.alias("end"), x["surface"].alias("surface"), x["before"].alias("before"), x["after"].alias("after")))
        return F.struct(end.alias("at"), F.concat(acc["out"], new).alias("out"))

    def placed(items: Column) -> Column:
        # places are running sums: within runs of matches, then over the runs
        def of(runs: Column) -> Column:
            lengths = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
            begins = F.aggregate(lengths, _sums(F.lit(0), "int"), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
            return F.flatten(F.zip_with(runs, begins, lambda r, at: F.aggregate(r, _sums(at, SPAN[6:-1]), add, lambda acc: acc["out"])))

        return let(_runs(items), of)

    def items(x: Column) -> Column:
        n = F.size(x["found"])
        pairs = F.zip_with(F.slice(x["gaps"], 1, n), x["found"], lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        return F.zip_with(pairs, F.slice(x["gaps"], 2, n), lambda x, after: F.struct(x["g"].alias("before"), x["m"].alias("surface"), after.alias("after"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size")))

    none = F.array().cast(SPAN)
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(gate), let(found, lambda x: F.when(F.size(x["found"]) > 0, placed(items(x))).otherwise(none))).otherwise(none)


def _sums(at: Column, kind: str) -> Column:
    return F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))


def _patterns(s: Column) -> Column:
    """The words next to a match: the last one or two before it, the first after it, in lower case, if they are words."""
    back = F.reverse(s["before"])
    left = F.reverse(F.regexp_extract(back, rf"^{SPACE}++({WORD}++)", 1))
    pair = F.regexp_replace(F.reverse(F.regexp_extract(back, rf"^{SPACE}++({WORD}++{SPACE}++{WORD}++)", 1)), rf"{SPACE}++", " ")
    right = F.regexp_extract(s["after"], rf"^{SPACE}++({WORD}++)", 1)
    named = ((left, "L "), (pair, "LL "), (right, "R "))
    return F.filter(F.array(*[F.when(w.rlike("^[^0-9@]+$"), F.concat(F.lit(n), F.lower(w))) for w, n in named]), lambda p: p.isNotNull())


def _luhn(surface: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(surface, "[^0-9]", ""), ""))
    values = F.transform(F.filter(digits, lambda d: d != ""), lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, surface: Column) -> Column:
    digits = F.length(F.regexp_replace(surface, "[^0-9]", ""))
    if kind == "ip":
        return surface.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return digits.between(14, 19) & _luhn(surface)
    return digits.between(10, 15) if kind == "phone" else F.lit(True)


def _join(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """row (a number), doc_id, base (array of spans), candidates (matches that no base span covers), both with the patterns around."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    for kind, (pattern, gate) in BASE.items():
        rows = rows.withColumn(kind, F.filter(matches(text, pattern, gate), (lambda k: lambda s: _valid(k, s["surface"]))(kind)))

    def named_spans(place: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lower(s["surface"]).alias("surface"), _patterns(s).alias("patterns")))

    rows = rows.withColumn("base", F.sort_array(F.concat(*[named_spans(i, k) for i, k in enumerate(KINDS)])))
    able = lambda s: (F.length(s["surface"]) >= 6) & (s["surface"].contains("@") | s["surface"].rlike("^(?:[^0-9]*+[0-9]){4}"))
    loose = F.filter(matches(text, TOKEN, "[0-9@]"), able)
    # a place ends where the text's own letters do; lower case, which may be longer, is for comparison only
    rows = rows.withColumn("loose", F.transform(loose, lambda s: F.struct(s["start"].alias("start"), F.regexp_replace(s["surface"], "[.,;:!?]+$", "").alias("surface"), _patterns(s).alias("patterns"))))
    rows = rows.withColumn("loose", F.transform("loose", lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["surface"])).alias("end"), F.lower(s["surface"]).alias("surface"), s["patterns"].alias("patterns"))))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", _apart(F.col("loose"), F.col("base")).alias("candidates"))


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others; the spans are in order and apart from each other, so runs of them meet only the others that lie there."""

    def left(x: Column) -> Column:
        near = F.transform(_runs(x["spans"]), lambda r: F.struct(r.alias("run"), F.filter(x["others"], lambda o: (o["start"] < F.element_at(r, -1)["end"]) & (o["end"] > r[0]["start"])).alias("near")))
        return F.flatten(F.transform(near, lambda y: F.filter(y["run"], lambda s: ~F.exists(y["near"], lambda o: (o["start"] < s["end"]) & (o["end"] > s["start"])))))

    return let(F.struct(spans.alias("spans"), others.alias("others")), lambda x: F.when((F.size(x["spans"]) > 0) & (F.size(x["others"]) > 0), left(x)).otherwise(x["spans"]))


def discovered(scanned: DataFrame) -> DataFrame:
    """(surface, kind) of candidates that the patterns of seeds, and then their own, make known."""
    one = lambda c: scanned.select(F.explode(c).alias("x"))
    seeds = one("base").select("x.surface", "x.kind", F.explode("x.patterns").alias("pattern")).distinct()
    loose = materialise(one("candidates").select("x.surface", F.explode("x.patterns").alias("pattern")).distinct(), "loose")
    seeds = materialise(seeds, "seeds")
    everything = materialise(seeds.select("pattern", "surface").unionByName(loose).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "patterns")
    known = materialise(scanned.sparkSession.createDataFrame([], "surface string, kind string"), "known")
    fits = F.coalesce(*[F.when((F.col("kind") == k) & F.col("surface").rlike(s), True) for k, s in SHAPE.items()], F.lit(False))
    while True:
        per_kind = seeds.select("pattern", "kind", "surface").unionByName(loose.join(known, "surface").select("pattern", "kind", "surface"))
        per_kind = per_kind.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("good"))
        strong = per_kind.filter(F.col("good") >= MIN_SEEDS).join(everything, "pattern").withColumn("confidence", F.col("good") / F.col("n")).filter(F.col("confidence") >= MIN_CONFIDENCE)
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        scored = loose.join(strong.select("pattern", "kind", "confidence"), "pattern").filter(fits).groupBy("surface", "kind").agg((1 - doubt).alias("score")).filter(F.col("score") >= MIN_CONFIDENCE)
        best = scored.groupBy("surface").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        new = materialise(best.join(known, "surface", "left_anti"), "new")
        if new.isEmpty():
            discard(new, loose, seeds, everything)
            return known
        before, known = known, materialise(known.unionByName(new), "known")
        discard(before, new)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of struct<start, place, end, kind>, sorted."""
    scanned = materialise(scan(docs), "scanned")
    known = discovered(scanned)
    own = scanned.select("row", F.explode("candidates").alias("x")).select("row", "x.start", "x.end", "x.surface")
    place = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    more = own.join(known, "surface").groupBy("row").agg(F.collect_set(F.struct("start", place.alias("place"), "end", "kind")).alias("more"))
    slim = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    out = scanned.select("row", "doc_id", slim(F.col("base")).alias("base")).join(more, "row", "left")
    return out.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", slim(F.col("more"))))).alias("spans"))


def digests(out: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(_join(F.col("base")).cast("binary"), 256).alias("base_sha256"), _join(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
