"""Personal data: fixed base kinds, and bootstrapped contextual extraction of further identifiers, all in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import SPACE, broadcast_or_shuffle, scratch_root, split_join, text_of, written

#: The kinds in the order of ties; the last is what the contextual method adds.
KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL = "A-Za-z0-9._%+-"
#: Possessive forms of the kinds' patterns. A match starts where its leading run of characters starts or the last match
#: ended, which is where the leftmost match of the plain pattern starts; so long runs are read once.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without a match of these have none of the kind.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: A slot, the shape of an unseen identifier: a word with a digit, of so many characters without what _EDGE names around it.
SLOT_CHARS = 4
_SLOT = rf"(?:(?<![^{SPACE}])|\G)[^{SPACE}0-9]*+[0-9][^{SPACE}]*+"
_EDGE = r"[\"'(\[{<>}\])=:;,.!?*#|$%&]"
#: A label glued to its value, as in name="value" or name:value; what follows is no address.
_GLUED = r"^[\p{L}_-]++[\"']?[=:]++[\"'(\[{<]*+(?=[^/\"'=:])"
#: Slots of this shape are seeds beside the base spans: keys and digests in hexadecimal, with letters and digits.
SECRET = r"^(?=[^0-9]*[0-9])(?=[^a-f]*[a-f])[0-9a-f]{32,}$"
ROUNDS = 5
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.6
MIN_SCORE = 0.8
_SPANS = "array<struct<start:int,kind:int,end:int,text:string,before:string,earlier:string,after:string>>"
_JUDGED = _SPANS.replace("after:string", "after:string,ok:boolean")
#: Running sums go by runs of so many numbers, so that long arrays are not copied for each number.
_RUN = 128


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the doubled digit sum from the right is a multiple of 10."""
    value = lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    return F.aggregate(F.transform(each, value), F.lit(0), lambda a, x: a + x) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(256)) <= 255),
    "card": lambda m: F.length(_digits(m)).between(14, 19) & _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(n: Column) -> Column:
    """Running sums of an array of numbers, each with the number itself: by runs, and over the runs' own sums."""
    add = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["all"], a["sum"] + x).alias("all"))
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
    sums = lambda x: F.aggregate(x, start, add, lambda a: a["all"])
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _RUN).cast("int")), lambda i: sums(F.slice(n, i * _RUN + 1, F.lit(_RUN))))
    whole = _let(runs, lambda r: _let(sums(F.transform(r, lambda x: F.element_at(x, -1))), lambda ends: F.flatten(F.transform(r, lambda x, i: F.transform(x, lambda v: v + F.when(i > 0, F.get(ends, i - 1)).otherwise(0))))))
    return F.when(F.size(n) > 0, whole).otherwise(F.array().cast("array<int>"))


def _last_word(text: Column) -> Column:
    """The last word of a text whose white space is spaces only."""
    return F.substring_index(F.rtrim(text), " ", -1)


def _matches(t: Column, pattern: str, kind: int) -> Column:
    """All matches with their places in code points, the two words before each and the word after it.

    Splitting by a pattern gives the text between its matches, so places are running sums of lengths. The words around
    are whole, however long, and may be matches themselves; letters or marks glued to a match belong to no word around.
    """
    found = F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"), F.split(t, pattern, -1).alias("gap"))

    def spans(x: Column) -> Column:
        m, gap = x["m"], F.transform(x["gap"], lambda g: F.translate(g, "\t\n\x0b\x0c\r", "     "))
        part = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))

        def one(g: Column, ends: Column) -> Column:
            def span(text: Column, i: Column) -> Column:
                back = F.concat(part(g, i - 2), part(m, i - 2), part(g, i - 1), part(m, i - 1), part(g, i))
                left = F.left(back, F.length(back) - F.when(F.endswith(back, F.lit(" ")), 0).otherwise(F.length(F.substring_index(back, " ", -1))))
                on = F.concat(part(g, i + 1), part(m, i + 1))
                right = F.when(F.startswith(on, F.lit(" ")), on).otherwise(F.substr(on, F.length(F.substring_index(on, " ", 1)) + 1))
                before = _last_word(left)
                rest = F.left(F.rtrim(left), F.length(F.rtrim(left)) - F.length(before))
                end = F.get(ends, i)
                return F.struct((end - F.length(text)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), text.alias("text"), before.alias("before"), _last_word(rest).alias("earlier"), F.substring_index(F.ltrim(right), " ", 1).alias("after"))

            return F.transform(m, span)

        lengths = F.transform(m, lambda y, i: F.length(y) + F.length(F.get(x["gap"], i)))
        return _let(gap, lambda g: _let(_running(lengths), lambda ends: one(g, ends)))

    return _let(found, spans)


def _judged(spans: Column, kind: str) -> Column:
    """The spans, each with whether it passes its kind's checks."""
    return F.transform(spans, lambda s: s.withField("ok", VALID[kind](s["text"])))


def _number_of(kind: str) -> Callable[[Column], Column]:
    """Whether a match has the length of its kind, passed or not; shorter runs of digits are no cards."""
    return lambda s: s["ok"] | (F.length(_digits(s["text"])) >= 14 if kind == "card" else F.lit(True))


def _none(kind: str = _SPANS) -> Column:
    return F.array().cast(kind)


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, base, slots): the base spans of every whole text and its slots; row numbers rows in a written table.

    base: valid matches of the four kinds, by start and kind. slots: the base spans, which are seeds, and words with a
    digit that overlap neither a base span nor a number that failed a check of its kind, trimmed of quotes, punctuation and
    a label glued to them, with the words around them. Of these, the ones of the shape SECRET are seeds too.
    """
    t = F.col("t")
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), text_of(text).alias("t"))
    guard = {k: F.contains(t, F.lit(g)) if k == "email" else t.rlike(g) for k, g in GUARDS.items()}
    kinds = {k: F.when(guard[k], _judged(_matches(t, PATTERNS[k], i), k)).otherwise(_none(_JUDGED)) for i, k in enumerate(KINDS[:4])}
    raw = named.select("row", "doc_id", *(c.alias(k) for k, c in kinds.items()), F.when(t.rlike("[0-9]"), _matches(t, _SLOT, 4)).otherwise(_none()).alias("raw"))
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = F.array_sort(F.concat(*(F.transform(F.filter(k, lambda s: s["ok"]), bare) for k in KINDS[:4])))
    taken = F.concat(*(F.transform(F.filter(k, _number_of(k)), bare) for k in KINDS[:4]))

    def slot(s: Column, start: Column, end: Column, core: Column, before: Column, of_base: bool) -> Column:
        return F.struct(
            start.alias("start"), end.alias("end"), F.lower(core).alias("text"), F.lower(before).alias("before"), *(F.lower(s[k]).alias(k) for k in ("earlier", "after")),
            (F.lit(of_base) | F.lower(core).rlike(SECRET)).alias("seed"), F.lit(of_base).alias("of_base"),
        )

    def trimmed(s: Column) -> Column:
        head = F.length(s["text"]) - F.length(F.regexp_replace(s["text"], f"^{_EDGE}+", ""))
        core = F.regexp_replace(s["text"], rf"^{_EDGE}+|{_EDGE}+$", "")
        label = F.regexp_extract(core, _GLUED, 0)
        glued = F.length(label) > 0
        value = F.substr(core, F.length(label) + 1)
        start = s["start"] + head + F.length(label)
        return slot(s, start, start + F.length(value), value, F.when(glued, label).otherwise(s["before"]), False)

    seeds = F.concat(*(F.transform(F.filter(k, lambda s: s["ok"]), lambda s: slot(s, s["start"], s["end"], s["text"], s["before"], True)) for k in KINDS[:4]))
    overlaps = lambda s: F.exists("taken", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    based = raw.select("row", "doc_id", base.alias("base"), taken.alias("taken"), seeds.alias("seeds"), F.filter(F.transform("raw", trimmed), lambda s: F.length(s["text"]) >= SLOT_CHARS).alias("raw"))
    return written(based.select("row", "doc_id", "base", F.concat("seeds", F.filter("raw", lambda s: ~overlaps(s))).alias("slots")), "pii-spans")


def _contexts(before: Column, earlier: Column, after: Column) -> Column:
    """Lexical patterns of a slot: the word before, the two words before, the word after, and its label; digits are all alike.

    A label ends in a colon or equals sign, glued or as a word of its own, whatever quotes stand around: token="x",
    "token": x and token = x have one label.
    """
    mark = r"[\"']?[=:]++[\"'(\[{<]*+$"
    labelled = F.when(before.rlike(r"^[=:]++[\"'(\[{<]*+$"), earlier).when(before.rlike(mark), F.regexp_replace(before, mark, ""))
    label = F.regexp_replace(labelled, r"^[^\p{L}\p{N}]++|[^\p{L}\p{N}]++$", "")
    shape = lambda c: F.regexp_replace(c, "[0-9]", "0")
    named = F.array(
        F.when(before != "", F.concat(F.lit("1:"), shape(before))),
        F.when((before != "") & (earlier != ""), F.concat(F.lit("2:"), shape(earlier), F.lit(" "), shape(before))),
        F.when(after != "", F.concat(F.lit("3:"), shape(after))),
        F.when(label != "", F.concat(F.lit("4:"), shape(label))),
    )
    return F.filter(named, lambda x: x.isNotNull())


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances) of distinct edges (pattern, instance, seed): confidences and scores after some rounds.

    A pattern is the word before, the two words before, the word after or the label of an instance. Its confidence is its
    instances' score over their number plus one, if that score reaches MIN_SUPPORT. A seed scores 1; another instance scores as unlikely as it is that all its patterns above MIN_CONFIDENCE err.
    """
    instances = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    patterns = None
    for _ in range(rounds):
        known = split_join(edges, instances, "instance")
        patterns = known.groupBy("pattern").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
        patterns = patterns.where(F.col("s") >= MIN_SUPPORT).select("pattern", (F.col("s") / (F.col("n") + 1)).alias("confidence")).where(F.col("confidence") >= MIN_CONFIDENCE).checkpoint()
        votes = edges.join(broadcast_or_shuffle(patterns, 100_000), "pattern", "left")
        chance = 1 - F.exp(F.sum(F.log(1 - F.coalesce("confidence", F.lit(0.0)))))
        instances = votes.groupBy("instance").agg(F.when(F.max("seed"), F.lit(1.0)).otherwise(chance).alias("score")).checkpoint()
    return patterns, instances


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, base, spans): one row for each row of docs; spans are arrays of struct<start, kind, end>.

    base holds the base kinds (KINDS numbers them). spans adds slots that overlap no base span, whose instance scores
    MIN_SCORE or more and that stand in a pattern of MIN_CONFIDENCE or more; seeds of the shape SECRET too only there. A
    slot is a word with a digit, of SLOT_CHARS characters or more; identifiers without a digit are not looked for, and
    numbers that failed a check of a base kind are none. Null texts are empty and have no span.
    """
    scratch_root(docs.sparkSession)
    rows = find_spans(docs, doc_id, text)
    slots = rows.select("row", F.explode("slots").alias("s")).select("row", "s.*").withColumn("pattern", F.explode(_contexts(F.col("before"), F.col("earlier"), F.col("after"))))
    slots = written(slots.select("row", "start", "end", "seed", "of_base", "pattern", F.xxhash64("text").alias("instance")), "pii-slots")
    edges = slots.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")).checkpoint()
    patterns, instances = score_patterns(edges)
    good = instances.where(F.col("score") >= MIN_SCORE).select("instance")
    new = slots.where("not of_base").join(broadcast_or_shuffle(patterns.select("pattern"), 100_000), "pattern", "left_semi")
    new = split_join(written(new, "pii-new"), good, "instance")
    new = new.groupBy("row").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("more"))
    both = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return rows.select("row", "doc_id", "base").join(new, "row", "left").select("row", "doc_id", "base", both.alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
