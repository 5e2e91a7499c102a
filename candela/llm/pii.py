"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

1. Four kinds (email, ip, card, phone) are found by expression and rule; these base spans are the seeds.
2. The words around a seed are its lexical patterns: the last word before it, the last two, the next word, the next two.
   All tokens that look like identifiers (with a digit or an at sign) and are not in a base span are the other instances.
3. Patterns and instances form a weighted bipartite graph. A pattern's confidence for a kind is the score-weighted
   share of all occurrences of its words in the corpus (whatever stands beside them) that its instances make up; an
   instance's score is one minus the product of the doubts of its confident patterns. A few rounds pass scores to and fro.
4. Instances that score high enough, and are shaped like their kind, are spans of that kind wherever they stand.

The base expressions are written with possessive repeats, and begin at a place where a run begins or the last match
ended. That changes no match, and keeps the time linear in the text and the stack flat.

Cases: null text counts as empty, without spans; equal rows and rows of one id are each kept; long texts are read
whole; instances of two kinds take the kind of the higher score, at a tie the first in the list of kinds; spans that
would overlap a base span are not added; an empty table gives an empty result; extra columns, whatever their names, are
kept by `redact` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")

# The four base expressions.
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: A pattern takes part if it stands before this many different seeds; with what confidence; and what an instance needs.
LEAST_SEEDS, LEAST_CONFIDENCE, LEAST_SCORE, ROUNDS = 3, 0.5, 0.5, 3
#: Bits of the table that tells which words may be patterns.
BITS = 1 << 18
#: Parts in which findings are joined to the rows of one text.
SALTS = 16
_BLOCK = 256


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def _blocks(lengths: Column) -> Column:
    """The sum of each block of lengths."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / _BLOCK).cast("int")), lambda k: _sum(F.slice(lengths, k * _BLOCK + 1, F.lit(_BLOCK))))


def _before(lengths: Column, prefix: Column, i: Column) -> Column:
    """The sum of the first i lengths."""
    k = F.floor(i / _BLOCK).cast("int")
    return F.get(prefix, k) + _sum(F.slice(lengths, k * _BLOCK + 1, i - k * _BLOCK))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def step(a: Column, i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _holds(kind: str, x: Column) -> Column:
    """Whether a match of the expression is of the kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        value = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(x, r"\."), lambda p: F.when(F.length(value(p)) <= 3, value(p).cast("int") <= 255).otherwise(False))
    n = F.length(_digits(x))
    return F.when((n >= 16) & (n <= 19), _luhn(_digits(x))).otherwise(False) if kind == "card" else (n >= 8) & (n <= 15)


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds __base, an array of (kind, start, end, value) in the order of kinds and starts."""
    t = F.col(text)
    # a text without the signs that the expression needs has no match
    may = {"email": F.contains(t, F.lit("@")), "ip": t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), "card": t.rlike("[0-9]{2}|[0-9][ -][0-9]"), "phone": F.contains(t, F.lit("+"))}
    none = F.array().cast("array<string>")
    df = df.withColumns({f"__m_{k}": F.when(may[k], F.regexp_extract_all(t, F.lit(e), F.lit(0))).otherwise(none) for k, e in EXPRESSIONS.items()})
    some = lambda k: F.exists(f"__m_{k}", lambda x: _holds(k, x))
    df = df.withColumns({f"__g_{k}": F.when(some(k), F.split(t, e, -1)).otherwise(none) for k, e in EXPRESSIONS.items()})
    # the lengths of gap and match in turn: the start of match i is the sum of the first 2 i + 1 of them
    lengths = lambda k: F.flatten(F.transform(F.arrays_zip(F.col(f"__g_{k}").alias("g"), F.col(f"__m_{k}").alias("m")), lambda z: F.array(F.length(z["g"]), F.coalesce(F.length(z["m"]), F.lit(0)))))
    df = df.withColumns({f"__l_{k}": F.when(F.size(f"__g_{k}") > 0, lengths(k)).otherwise(F.array().cast("array<int>")) for k in KINDS})
    df = df.withColumns({f"__b_{k}": _blocks(F.col(f"__l_{k}")) for k in KINDS})
    summed = lambda k: F.transform(F.sequence(F.lit(1), F.size(f"__b_{k}")), lambda i: _sum(F.slice(f"__b_{k}", F.lit(1), i - 1)))
    df = df.withColumns({f"__p_{k}": summed(k) for k in KINDS})

    def spans(k: str) -> Column:
        numbered = F.transform(F.col(f"__m_{k}"), lambda x, i: F.struct(x.alias("value"), i.alias("i")))
        kept = F.filter(numbered, lambda c: _holds(k, c["value"])) if k != "email" else numbered
        start = lambda c: _before(F.col(f"__l_{k}"), F.col(f"__p_{k}"), 2 * c["i"] + 1)
        placed = F.transform(kept, lambda c: F.struct(F.lit(k).alias("kind"), start(c).alias("start"), c["value"].alias("value")))
        return F.transform(placed, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), (c["start"] + F.length(c["value"])).alias("end"), c["value"].alias("value")))

    whole = F.concat(*[F.when(F.size(f"__g_{k}") > 0, spans(k)).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")) for k in KINDS])
    return df.withColumn("__base", whole).drop(*[f"__{x}_{k}" for x in "mglbp" for k in KINDS])


def _plain(piece: Column) -> Column:
    """A word as it stands in patterns: in lower case, digits as 0, without white space; null for none."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(piece), "[0-9]", "0"), r"\s+$", ""), F.lit(""))


def _index(lengths: Column, prefix: Column, position: Column) -> Column:
    """The number of the piece that holds a position."""
    k = F.size(F.filter(prefix, lambda p: p <= position)) - 1
    start = F.struct(F.get(prefix, k).alias("at"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        past = a["done"] | (a["at"] + x > position)
        return F.struct(F.when(past, a["at"]).otherwise(a["at"] + x).alias("at"), F.when(past, a["n"]).otherwise(a["n"] + 1).alias("n"), past.alias("done"))

    return k * _BLOCK + F.aggregate(F.slice(lengths, k * _BLOCK + 1, F.lit(_BLOCK)), start, step, lambda a: a["n"])


def near_pieces(df: DataFrame, text: str) -> DataFrame:
    """Adds __pieces, words with the white space after them, and __lengths, theirs; none if no word has a digit or an at sign.

    Of the words between two that have such a mark, the first two and the last two are pieces. What stands between those is one empty piece
    with its length, as no span and no pattern needs it: so the work follows the marked words.
    """
    t, mark = F.col(text), r"[0-9@]\S*+\s*+"
    none = F.array().cast("array<string>")
    # a gap begins with a word, and ends with the letters before a mark
    df = df.withColumn("__marks", F.regexp_extract_all(t, F.lit(mark), F.lit(0)))
    df = df.withColumn("__gaps", F.when(F.size("__marks") > 0, F.split(t, mark, -1)).otherwise(none))
    first = lambda g: F.regexp_extract(g, r"^\s*+(?:\S++\s++){0,2}", 0)
    last = lambda g: F.reverse(F.regexp_extract(F.reverse(g), r"^\S*+(?:\s++\S++){0,2}", 0))
    ends = F.transform(F.arrays_zip(F.col("__gaps").alias("g"), F.col("__marks").alias("m")), lambda z: F.struct(z["g"].alias("gap"), F.coalesce(z["m"], F.lit("")).alias("mark"), first(z["g"]).alias("first"), last(z["g"]).alias("last")))
    df = df.withColumn("__ends", ends)
    far = lambda z: F.length(z["gap"]) - F.length(z["first"]) - F.length(z["last"])
    cut = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"^\s++|\S++\s*+"), F.lit(0)), lambda p: F.struct(p.alias("piece"), F.length(p).alias("n")))
    cells = F.transform("__ends", lambda z: F.when(far(z) > 0, F.concat(cut(z["first"]), F.array(F.struct(F.lit("").alias("piece"), far(z).alias("n"))), cut(F.concat(z["last"], z["mark"])))).otherwise(cut(F.concat(z["gap"], z["mark"]))))
    df = df.withColumn("__cells", F.flatten(cells))
    return df.withColumns({"__pieces": F.col("__cells.piece"), "__lengths": F.col("__cells.n")}).drop("__marks", "__gaps", "__ends", "__cells")


def with_instances(based: DataFrame, text: str) -> DataFrame:
    """Adds __found, the seeds of __base and the other instances: an array of start, end, value, kind (null: no seed), patterns.

    Pieces are words with the white space after them; a pattern is a side (L, R), the number of its words, and the words.
    A side where no white space stands next to the span has no patterns.
    """
    rows = near_pieces(based, text).withColumn("__blocks", _blocks(F.col("__lengths")))
    rows = rows.withColumn("__prefix", F.transform(F.sequence(F.lit(1), F.size("__blocks")), lambda i: _sum(F.slice("__blocks", F.lit(1), i - 1))))
    lengths, prefix = F.col("__lengths"), F.col("__prefix")
    marked = F.filter(F.transform("__pieces", lambda x, i: F.struct(x.alias("piece"), i.alias("i"))), lambda c: c["piece"].rlike("[0-9@]"))
    core = lambda x: F.regexp_extract(x, r"[\p{L}0-9+@](?:\S*[\p{L}0-9@])?", 0)
    placed = F.transform(marked, lambda c: F.struct((_before(lengths, prefix, c["i"]) + F.position(core(c["piece"]), c["piece"]) - 1).alias("start"), core(c["piece"]).alias("value")))
    free = F.filter(placed, lambda c: ~F.exists("__base", lambda b: (b["start"] < c["start"] + F.length(c["value"])) & (c["start"] < b["end"])) & (F.length(c["value"]) > 0))
    spans = F.concat(
        F.transform("__base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["value"].alias("value"), b["kind"].alias("kind"))),
        F.transform(free, lambda c: F.struct(c["start"].alias("start"), (c["start"] + F.length(c["value"])).alias("end"), c["value"].alias("value"), F.lit(None).cast("string").alias("kind"))),
    )
    rows = rows.withColumn("__spans", F.transform(spans, lambda o: F.struct(*[o[n].alias(n) for n in ("start", "end", "value", "kind")], _index(lengths, prefix, o["start"]).alias("i"), _index(lengths, prefix, o["end"] - 1).alias("j"))))
    piece = lambda i: F.get(F.col("__pieces"), i)

    def patterns(o: Column) -> Column:
        i, j = o["i"], o["j"]
        left, right = _before(lengths, prefix, i) == o["start"], _before(lengths, prefix, j) + F.length(F.regexp_replace(piece(j), r"\s+$", "")) == o["end"]
        b1, b2, a1, a2 = F.when(left, _plain(piece(i - 1))), F.when(left, _plain(piece(i - 2))), F.when(right, _plain(piece(j + 1))), F.when(right, _plain(piece(j + 2)))
        gap = F.lit(" ")
        return F.filter(F.array(F.concat(F.lit("L1 "), b1), F.concat(F.lit("L2 "), b2, gap, b1), F.concat(F.lit("R1 "), a1), F.concat(F.lit("R2 "), a1, gap, a2)), lambda p: p.isNotNull())

    found = F.transform("__spans", lambda o: F.struct(*[o[n].alias(n) for n in ("start", "end", "value", "kind")], patterns(o).alias("patterns")))
    return rows.withColumn("__found", found).drop("__pieces", "__lengths", "__blocks", "__prefix", "__spans")


def _bit(pattern: Column) -> Column:
    return F.pmod(F.xxhash64(pattern), F.lit(BITS))


def pattern_totals(df: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """pattern, total: how often the words of each pattern stand in the texts, whatever stands beside them.

    A table of BITS bits, of one size for any input, lets through the words that may be patterns; the join decides.
    """
    sought = patterns.select("pattern", F.expr("substr(pattern, 2)").alias("words"))
    # bits of the words of patterns, and bits of their last words
    marks = sought.select(F.explode(F.array(F.struct(F.lit(0).alias("of"), _bit(F.col("words")).alias("b")), F.struct(F.lit(1).alias("of"), _bit(F.substring_index("words", " ", -1)).alias("b")))).alias("m")).select("m.*")
    shifted = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 32).cast("int"))
    bits = {(r.of, r.at): r.value for r in marks.groupBy("of", (F.col("b") / 32).cast("int").alias("at")).agg(F.bit_or(shifted).alias("value")).collect()}
    if not bits:
        return patterns.select("pattern", F.lit(0).cast("long").alias("total"))
    tables = [F.split(F.lit(",".join(str(bits.get((of, i), 0)) for i in range(BITS // 32))), ",").cast("array<bigint>") for of in (0, 1)]
    may = lambda of, p: F.call_function("shiftright", F.get(tables[of], (_bit(p) / 32).cast("int")), (_bit(p) % 32).cast("int")).bitwiseAND(F.lit(1)) == 1
    # the first and the last word may be empty; as an outer explode, since for another Spark would split each text twice, once to see whether it has words
    plain = df.select(F.split(F.regexp_replace(F.lower(text), "[0-9]", "0"), r"\s+").alias("w"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("w", F.lit(1), F.size("w") - 1))
    each = plain.select(F.explode_outer(F.arrays_zip(before.alias("first"), F.col("w").alias("last"))).alias("p"))
    pairs = each.where((F.col("p.last") != "") & may(1, F.col("p.last"))).select("p.last", F.nullif(F.col("p.first"), F.lit("")).alias("first"))
    one, two = F.concat(F.lit("1 "), F.col("last")), F.concat(F.lit("2 "), F.col("first"), F.lit(" "), F.col("last"))
    grams = pairs.select(F.when(may(0, one), one).alias("one"), F.when(may(0, two), two).alias("two")).where(F.col("one").isNotNull() | F.col("two").isNotNull())
    counted = grams.select(F.explode(F.filter(F.array("one", "two"), lambda p: p.isNotNull())).alias("words")).groupBy("words").agg(F.count("*").alias("total"))
    return sought.join(counted, "words").select("pattern", "total")


def _shaped(kind: Column, value: Column) -> Column:
    n, plain = F.length(_digits(value)), ~value.rlike(r"\p{L}")
    return (
        F.when(kind == "email", F.contains(value, F.lit("@")))
        .when(kind == "ip", value.rlike(r"^[0-9]+([.:][0-9]+){3,}$"))
        .when(kind == "card", plain & (n >= 8) & (n <= 19))
        .otherwise(plain & (n >= 5) & (n <= 15))
    )


def bootstrap(found: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, value, score of the instances that are discovered. found: occurrences; totals: of the patterns used."""
    fresh = lambda c: F.concat(F.col(c), F.lit("")).alias(c)
    edges = found.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value", "kind").agg(F.count("*").alias("n"))
    edges = common.checkpointed(edges.join(totals.select(fresh("pattern"), "total"), "pattern"))
    others = edges.where(F.col("kind").isNull()).select("pattern", "value", "n", "total")
    seeds = edges.where(F.col("kind").isNotNull()).groupBy("pattern", "kind", "total").agg(F.sum("n").alias("mass"), F.count("*").alias("seeds"))
    seeds = common.checkpointed(seeds.where(F.col("seeds") >= LEAST_SEEDS))
    scores = None
    for _ in range(rounds):
        mass = seeds.select("pattern", "kind", "total", "mass")
        if scores is not None:
            gained = others.join(scores.select("kind", fresh("value"), "score"), "value").groupBy("pattern", "kind", "total").agg(F.sum(F.col("n") * F.col("score")).alias("mass"))
            mass = mass.unionByName(gained)
        strong = mass.groupBy("pattern", "kind", "total").agg(F.sum("mass").alias("mass")).select("pattern", "kind", (F.col("mass") / (F.col("total") + 1)).alias("confidence")).where(F.col("confidence") >= LEAST_CONFIDENCE)
        doubts = others.join(strong.select(fresh("pattern"), "kind", F.least("confidence", F.lit(0.999)).alias("confidence")), "pattern").where(_shaped(F.col("kind"), F.col("value")))
        scores = doubts.groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")).where(F.col("score") >= LEAST_SCORE)
        scores = common.checkpointed(scores)
    return scores


def find_personal_data(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """keep columns, __base and __all: arrays of (kind, start, end)."""
    kept = [f"__k{i}" for i in range(len(keep))]
    rows = common.numbered(df).select(*[F.col(common.place(df, c)).alias(k) for c, k in zip(keep, kept, strict=True)], common.text_of(common.place(df, text)).alias("__text"))
    texts = rows.select("__text")
    # rows of one text may be many, so what is found in a text is joined to them in so many parts
    salt = F.pmod(F.xxhash64(*[k for k, t in rows.dtypes if "map<" not in t], F.lit(1)), F.lit(SALTS))
    rows = with_instances(base_spans(rows.withColumns({"__hash": F.xxhash64("__text"), "__size": F.length("__text"), "__salt": salt}), "__text"), "__text")
    slim = lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"))
    rows = common.checkpointed(rows.select(*kept, "__hash", "__size", "__salt", F.transform("__base", slim).alias("base"), "__found"))
    found = rows.select("__hash", "__size", F.explode("__found").alias("o")).select("__hash", "__size", "o.*")
    seeded = found.where(F.col("kind").isNotNull()).select(F.explode("patterns").alias("pattern"), "value").distinct().groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEDS).select("pattern")
    seeded = common.checkpointed(seeded)
    scores = bootstrap(found, pattern_totals(texts, "__text", seeded), rounds)
    best = scores.groupBy("value").agg(F.max_by("kind", F.struct("score", *[(F.col("kind") == k).alias(k) for k in KINDS])).alias("kind"))
    new = found.where(F.col("kind").isNull()).drop("kind", "patterns").join(best.select(F.concat("value", F.lit("")).alias("value"), "kind"), "value")
    new = new.groupBy("__hash", "__size").agg(F.collect_set(F.struct("kind", "start", "end")).alias("new"))
    new = new.select("__hash", "__size", "new", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__salt"))
    joined = rows.select(*kept, "__hash", "__size", "__salt", "base").join(new, ["__hash", "__size", "__salt"], "left")
    rank = F.lit(0)
    order = lambda s: sum((F.when(s["kind"] == k, F.lit(i)).otherwise(F.lit(0)) for i, k in enumerate(KINDS)), rank)
    ranked = F.array_sort(F.transform(F.concat("base", F.col("new")), lambda s: F.struct(order(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    whole = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return joined.select(*kept, "base", whole).toDF(*keep, "__base", "__all")


def written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are replaced as one."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    sorted_spans = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(F.substr(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.when(s["start"] >= a["at"], F.concat(a["out"], piece)).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(sorted_spans, empty, step, lambda a: F.concat(a["out"], F.substr(text, a["at"].cast("int") + 1, F.length(text)))))


def redact(df: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """df with its spans of personal data replaced, and the column of the number of characters, if named, set anew."""
    own = common.numbered(df)
    t, size = common.place(df, text), common.place(df, n_chars) if n_chars in df.columns else None
    found = find_personal_data(own, tuple(own.columns), t)
    found = found.withColumn(t, F.when(F.size("__all") > 0, redacted(F.col(t), F.col("__all"))).otherwise(F.col(t)))
    if size:
        found = found.withColumn(size, F.when(F.size("__all") > 0, F.length(t).cast(dict(own.dtypes)[size])).otherwise(F.col(size)))
    return found.select(*own.columns).toDF(*df.columns)


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(common.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("__base")), 256).alias("base_sha256"), written(F.col("__all")).alias("spans"))


def planted(documents: DataFrame) -> DataFrame:
    """Each document after a sentence with a number of 16 digits made of its id: of every fourth with a wrong check digit.

    No expression finds those, but the words around them tell what they are.
    """
    payload = F.lpad((F.col("doc_id") * 104729 + 400000000000).cast("string"), 15, "4")
    digit = lambda k: F.substring(payload, 15 - k, 1).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    check = (10 - sum((twice(digit(k)) if k % 2 == 0 else digit(k) for k in range(15)), F.lit(0)) % 10) % 10
    wrong = F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)
    number = F.concat(payload, ((check + wrong) % 10).cast("string"))
    return documents.select("doc_id", F.concat(F.lit("charge card "), number, F.lit(" expires soon. "), common.text_of("text")).alias("text"))


def planted_card_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of documents with planted numbers: the bootstrap alone finds those with a wrong check digit."""
    found = find_personal_data(planted(common.table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.size("__base").cast("long").alias("n_base"), written(F.col("__all")).alias("spans"))
