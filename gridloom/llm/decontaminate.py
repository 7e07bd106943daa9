"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers (in digits or words), names and units become typed placeholders, a run of names or number words one of them, everything else lower-cased words;
punctuation is not looked at. That is done by a chain of replacements on whole texts. Windows of the canonical words are hash-joined
between documents and benchmark items. Every hit is then verified on the words themselves, and its slots are checked for consistency: the
slots of the item's window that hold one value hold one value in the document too, and different ones differ, so
``Anna gave Ben 3 km of rope and left`` meets ``Mary Ann gave Tom seven miles of rope and left`` and not ``Eva gave Eva 7 miles of rope and left``.

A capital is read as a name's in documents, at the start of a sentence too, where no text tells names from other words. Items have three readings: the same, one with their first
word, and one with all words at starts as words, so they meet documents that write these small.

Windows of few literal words would meet too much. Where none of enough begins within half a window of them, so that 12 words of an item always hold one, there stand in their place
longer windows about them that have enough, and the item's very words, without
placeholders. Where no longer one has enough, each of the item's clauses, of five tokens and a literal word at least, is a template too, which only a whole clause of a document meets.
So no item is without a window, but those without any word or number, which ``unsearchable`` lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, filled

WINDOW = 8
#: Words that must be literal in a window of canonical words; windows of fewer words need all of theirs.
LITERALS = 5
#: Items of fewer words than this are found only where their very words are a whole sentence or line, or anywhere if of a script without spaces.
SHORTEST = 5
#: Bytes of benchmark windows, and of pairs of an id and a hash, that are broadcast at most; beyond that both sides are shuffled.
BROADCAST_BYTES = 64 << 20

#: Marks within a text that is worked on: start of a clause, the openings of name, number and unit, their end, and a point within a number; and for a
#: while, the opening of a number word and the end of a name.
START, NAME, NUMBER, UNIT, END, POINT, NUMBER_WORD, NAME_END = (chr(i) for i in range(1, 9))
#: Before a word that is to be read as one, and what parts runs of names and numbers: signs of arithmetic.
WORD, BREAK = chr(11), chr(14)
OPENINGS = NAME + NUMBER + UNIT
#: Scripts that don't part words, whose tokens are clauses.
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
_UNSPACED_JAVA = UNSPACED.replace("\\p{", "\\p{Is")
#: Unit words that count as units straight after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz pound pounds ounce ounces ton tons "
    "ml cl l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent kb mb gb tb hz khz mhz ghz w kw v mph kmh degrees"
).split()
#: Number words.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()


def _either(words: list[str]) -> str:
    """A pattern for the words in any case of their letters, parted letter by letter, so that a word that is none of them fails at once."""
    rest: dict[str, list[str]] = {}
    for w in words:
        rest.setdefault(w[:1], []).append(w[1:])
    parts = [f"[{c}{c.upper()}]{_either(more)}" for c, more in rest.items() if c]
    if "" in rest:
        return f"(?:{'|'.join(parts)})?" if parts else ""
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


#: ASCII letters are named though they are among the others, as engines look them up at once.
_ONE_NAME = r"[A-Z\p{Lu}\p{Lt}][a-z\p{Ll}\p{Lo}\p{Lm}\p{M}]+"
_ONE_NUMBER = _either(NUMBERS)
#: First the text in parts: (pattern, what it becomes). Nothing in them looks around, so any engine reads them alike.
PARTED = (
    *[(r"([0-9])[.,:]([0-9])", rf"\1{POINT}\2")] * 2,  # again for the points on both sides of a single digit
    (r"[+*/=]", f" {BREAK} "),
    (" - ", f" {BREAK} "),
    (rf"[^a-zA-Z0-9.!?:;\n{POINT}{BREAK}\p{{L}}\p{{M}}]+", " "),
    (r"[.!?:;\n][ .!?:;\n]*", f" {START}"),
)
DIGITS = (rf"([0-9][0-9{POINT}]*)", rf"  {NUMBER}\1{END}  ")
#: Then the slots, in a text in which each token has a space of its own on both sides. Runs are put together slot by slot, as an engine that
#: matched a run at once would need a stack as long.
NUMBERED = (
    (rf" ({_ONE_NUMBER}) ", rf" {NUMBER_WORD}\1{END} "),
    (f"{END}  {NUMBER_WORD}", "  "),
    (NUMBER_WORD, NUMBER),
    (rf"{END}  ({_either(UNITS)}) ", rf"{END}  {UNIT}\1{END} "),
)
NAMED = (
    (rf" ({_ONE_NAME}) ", rf" {NAME}\1{NAME_END} "),
    (f"{NAME_END}  {NAME}", "  "),
    (NAME_END, END),
)
#: A token of a text with slots, the same with placeholders for slots, and a token of a text in parts.
TOKEN, EMPTIED, PLAIN = rf"[{OPENINGS}][^{END}]*{END}|[^ {OPENINGS}{END}]+", (rf"([{OPENINGS}])[^{END}]*{END}", r"\1"), rf"{START}?(?:[0-9][0-9{POINT}]*|[a-zA-Z\p{{L}}\p{{M}}]+)"


def is_pattern(pattern: str) -> bool:
    """Whether there is more in it than characters that stand for themselves."""
    return any(c in pattern for c in "[(+*\\")


def _replaced(text: Column, pattern: str, by: str) -> Column:
    if not is_pattern(pattern):
        return F.replace(text, F.lit(pattern), F.lit(by))
    return F.regexp_replace(text, F.lit(pattern), F.lit(by.replace("\\", "$")))


def _without(text: Column, marks: str, by: str = "") -> Column:
    """Mark by mark, which is quick where there are none."""
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(by))
    return text


#: Readings of words at the starts of clauses: names by their capitals, the text's first one a word, all of them words.
READINGS = ("names", "first", "words")
#: What a text with slots begins with.
OPENED = f"  {START}  "


def parted(text: Column) -> Column:
    """Words, numbers and starts of clauses of a text."""
    text = _without(text, POINT + WORD + BREAK, " ")
    for pattern, by in PARTED:
        text = _replaced(text, pattern, by)
    return F.concat(F.lit(START), F.ltrim(text, F.lit(f" {START}")))


def spaced(parts: Column) -> Column:
    """A text in parts, each token of it with a space of its own on both sides, numbers in digits as slots."""
    apart = F.replace(parts, F.lit(START), F.lit(f"{START} "))
    return _replaced(F.concat(F.lit(" "), _replaced(apart, *DIGITS), F.lit(" ")), " +", "  ")


def with_starts(parts: Column, reading: str = "names") -> Column:
    """A text in parts with its names, numbers and units as slots, in lower case; starts of clauses are tokens of their own."""
    return _with_slots(spaced(parts), reading)


def _with_slots(text: Column, reading: str = "names") -> Column:
    """As ``with_starts``, of a spaced text."""
    for pattern, by in NUMBERED:
        text = _replaced(text, pattern, by)
    if reading == "words":
        text = F.replace(text, F.lit(f"{START}  "), F.lit(f"{START}  {WORD}"))
    elif reading == "first":
        text = F.concat(F.lit(OPENED + WORD), F.substr(text, F.lit(len(OPENED) + 1)))
    for pattern, by in NAMED:
        text = _replaced(text, pattern, by)
    return _without(F.lower(text), WORD + BREAK)


def slotted(parts: Column) -> Column:
    """As ``with_starts``, without the starts of clauses."""
    return _flat(with_starts(parts))


def _flat(slots: Column) -> Column:
    """A text with slots without the starts of clauses."""
    return F.replace(slots, F.lit(START), F.lit(""))


def _clauses(slots: Column) -> Column:
    """The clauses of a text with slots, from the second place on; what stands at the first is blank."""
    return F.split(slots, START)


def _tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _canonical(slots: Column) -> Column:
    """Words, and placeholders for slots."""
    return F.split(F.trim(_replaced(slots, *EMPTIED)), " +")


def _emptied(slots: Column) -> Column:
    """A text with slots as words and placeholders with a space between them, starts of clauses among them."""
    return _replaced(_replaced(slots, *EMPTIED), " +", " ")


def _plainly(text: Column) -> Column:
    """The plain words of a spaced text, without starts of clauses."""
    return F.split(F.trim(_without(F.lower(text), START + BREAK + NUMBER + END)), " +")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _paired(hashes: Column, step: Column | int) -> Column:
    """From the hashes of windows those of windows longer by ``step``. Too near the end for one there stands another hash, which is no window's.

    ``hashes`` must be a column that is there, as it is read again for each place.
    """
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))


def _key(words: Column) -> Column:
    """What a window is joined by: the hashes of its words are paired, and these pairs again, until two of them, next to each other or overlapping, cover the window."""
    n = F.size(words)
    cut_pairs = lambda acc, step: F.slice(_paired(acc, step), F.lit(1), F.size(acc) - step)
    steps = F.array(*[F.lit(1 << k) for k in range(16)])
    acc = F.aggregate(steps, _hashed(words), lambda acc, step: F.when(2 * step <= n, cut_pairs(acc, step)).otherwise(acc))
    return F.when(F.size(acc) == 1, F.get(acc, F.lit(0))).otherwise(F.xxhash64(F.get(acc, F.lit(0)), F.get(acc, F.size(acc) - 1)))


def _with_pairs(rows: DataFrame, hashes: str, lengths: list[int]) -> DataFrame:
    """``rows`` with the hashes of windows of 2, 4, 8 .. words as columns, up to the longest of ``lengths``."""
    span = 1
    while 2 * span <= max(lengths, default=0):
        rows = rows.withColumn(f"{hashes}_{2 * span}", _paired(F.col(hashes if span == 1 else f"{hashes}_{span}"), span))
        span *= 2
    return rows


def _keys(hashes: str, length: int) -> Column:
    """The keys (``_key``) of all windows of a length, by the columns of ``_with_pairs``; a word is hashed once for all windows it is in."""
    span = 1 << length.bit_length() - 1
    pairs = F.col(hashes if span == 1 else f"{hashes}_{span}")
    return pairs if span == length else _paired(pairs, length - span)


def _whole_keys(words: Column, keys: Column, length: int) -> Column:
    """Of the keys of all windows of plain words those of windows that are a sentence or line, by the words with marks of starts; the rest is null."""
    opens = lambda i: F.startswith(F.get(words, i), F.lit(START))
    whole = lambda i: opens(i) & ((i + length == F.size(words)) | opens(i + length))
    return F.transform(keys, lambda key, i: F.when(whole(i), key))


def _unmarked(words: Column) -> Column:
    return F.transform(words, lambda w: F.replace(w, F.lit(START), F.lit("")))


def _slots(tokens: Column) -> Column:
    """For each slot the place of the first slot that has its kind and value; two windows agree if these are the same."""
    held = F.filter(tokens, lambda t: F.substring(t, 1, 1).isin(*OPENINGS))
    return F.transform(held, lambda t: F.array_position(held, t))


def _no_slots() -> Column:
    return F.array().cast("array<bigint>")


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item, pos, length, exact, whole, words, slots, key for each distinct window, of all readings of the item.

    ``item`` is a structure of the id, as a null id too is to be joined by. A window of canonical words that has too few literal ones, and none beside it that has enough, gives way
    to the first longer one about it that has enough, if there is one, and its item has all windows of plain words (``exact``) besides. If there is none, its item's clauses
    are templates as wholes, of length 0 and negative places.
    """
    items = benchmark.select(F.struct(F.col(id_col).alias("id")).alias("item"), parted(filled(text_col)).alias("parts"))
    items = items.select("item", "parts", _tokens(F.lower("parts"), PLAIN).alias("plain"), F.explode(F.array(*[with_starts(F.col("parts"), r) for r in READINGS])).alias("slotted"))
    items = items.select("item", "parts", "plain", "slotted", _tokens(_flat(F.col("slotted"))).alias("tokens"), _canonical(_flat(F.col("slotted"))).alias("words")).where(F.size("plain") > 0)
    literal = lambda start, size: F.size(F.filter(F.slice("words", start, size), lambda w: ~w.isin(*OPENINGS)))
    length = F.least(F.size("words"), F.lit(window))
    rows = items.withColumn("length", length).withColumn("starts", F.when(F.size("words") >= SHORTEST, F.sequence(F.lit(1), F.size("words") - length + 1)))
    poor = lambda at: literal(at, F.col("length")) < F.least(F.col("length"), F.lit(LITERALS))
    rows = rows.withColumn("rich", F.filter("starts", lambda at: ~poor(at))).withColumn("pos", F.explode_outer("starts"))
    few = F.col("pos").isNull() | poor(F.col("pos"))
    rows = rows.where(~few | ~F.coalesce(F.exists("rich", lambda at: F.abs(at - F.col("pos")) <= window // 2), F.lit(False)))
    shape = lambda start, size: F.struct(start.cast("int").alias("start"), size.alias("size"))
    longer = F.lit(None)
    for times in (4, 2):
        size = F.least(F.size("words"), F.lit(times * window))
        start = F.least(F.col("pos"), F.size("words") - size + 1)
        longer = F.when((size > F.col("length")) & (literal(start, size) >= LITERALS), shape(start, size)).otherwise(longer)
    rows = rows.withColumn("few", few).withColumn("shape", F.when(~few, shape(F.col("pos"), F.col("length"))).otherwise(F.when(F.col("pos").isNotNull(), longer)))
    part = lambda c: F.slice(c, F.col("shape.start"), F.col("shape.size"))
    templates = rows.where("shape is not null").select("item", "pos", F.col("shape.size").alias("length"), F.lit(False).alias("exact"), F.lit(False).alias("whole"), part("words").alias("words"), _slots(part("tokens")).alias("slots"))
    n = F.size("plain")
    plain = rows.where("few").select("item", "parts", "plain", F.least(n, F.lit(window)).alias("length")).withColumn("pos", F.explode(F.sequence(F.lit(1), n - F.col("length") + 1)))
    whole = (n < SHORTEST) & ~F.regexp_like("parts", F.lit(_UNSPACED_JAVA))
    exact = plain.select("item", "pos", "length", F.lit(True).alias("exact"), whole.alias("whole"), _unmarked(F.slice("plain", F.col("pos"), F.col("length"))).alias("words"), _no_slots().alias("slots"))
    clauses = rows.where("few and shape is null").select("item", F.posexplode(_clauses(F.col("slotted"))).alias("nth", "clause"))
    clauses = clauses.select("item", (-F.col("nth")).alias("pos"), F.lit(0).alias("length"), F.lit(False).alias("exact"), F.lit(False).alias("whole"), _canonical(F.col("clause")).alias("words"), _slots(_tokens(F.col("clause"))).alias("slots"))
    clauses = clauses.where((F.size("words") >= SHORTEST) & (F.size(F.filter("words", lambda w: ~w.isin(*OPENINGS))) > 0))
    return templates.unionByName(exact).unionByName(clauses).dropDuplicates(["item", "pos", "exact", "whole", "words", "slots"]).withColumn("key", F.when(F.col("length") > 0, _key(F.col("words"))).otherwise(F.xxhash64(F.array_join("words", " "))))


def unsearchable(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The items that no document can be searched for, as they have neither a word nor a number."""
    return benchmark.where(F.size(_tokens(parted(filled(text_col)), PLAIN)) == 0).select(id_col)


def _small(rows: DataFrame, each: Column) -> DataFrame:
    """``rows`` to be broadcast if they are of few bytes."""
    return F.broadcast(rows) if (rows.agg(F.sum(each)).first()[0] or 0) <= BROADCAST_BYTES else rows


def _probes(bench: DataFrame, window: int) -> DataFrame:
    """(_length, _exact, _key, _then, full, whole): what windows of documents are looked up in, one row for each template, however many items have it.

    A template of two windows or more is found by its first window, whose place must have the second (``_then``) behind it; its length is ``full``.
    """
    two = ~F.col("exact") & (F.col("length") >= 2 * window)
    nth = lambda k: _key(F.slice("words", k * window + 1, window))
    rows = bench.select(F.when(two, F.lit(window)).otherwise(F.col("length")).alias("_length"), F.col("exact").alias("_exact"), F.when(two, nth(0)).otherwise(F.col("key")).alias("_key"), F.when(two, nth(1)).alias("_then"), F.col("length").alias("full"), "whole")
    return rows.groupBy("_length", "_exact", "_key", "_then", "full").agg(F.min("whole").alias("whole"))


def _found(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(doc, exact, words, slots) distinct: the benchmark's windows that documents hold, ``doc`` being a structure of an id and a hash of its text."""
    probes = _probes(bench, window)
    kinds = sorted((r[0], r[1]) for r in probes.select("_exact", "_length").distinct().collect())  # exact ones of at most window lengths, others of less than 2 * window
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(filled(text_col)).alias("th")).alias("doc"), parted(filled(text_col)).alias("parts"))
    exact, template = ([k for k in kinds if k[0] == flag] for flag in (True, False))
    short = [n for _, n in exact if n < SHORTEST]
    whole_clauses = (False, 0) in kinds
    none = F.array().cast("array<string>")

    def worded(rows: DataFrame) -> DataFrame:
        """The texts with slots, and their words and placeholders."""
        rows = rows.withColumn("spaced", spaced(F.col("parts")))
        if not template:
            return rows.select("*", F.lit(None).cast("string").alias("slotted"), none.alias("words"), none.alias("clauses"))
        rows = rows.withColumn("slotted", _with_slots(F.col("spaced")))
        rows = rows.withColumn("emptied", _emptied(F.col("slotted")))
        words = F.split(F.trim(F.replace("emptied", F.lit(f"{START} "), F.lit(""))), " ")
        return rows.select("*", words.alias("words"), (_clauses(F.col("emptied")) if whole_clauses else none).alias("clauses"))

    made = worded(rows)
    hashed = lambda on, words: _hashed(words) if on else F.array().cast("array<bigint>")
    made = made.select("doc", "parts", "clauses", hashed(template, F.col("words")).alias("words"), hashed(exact, _plainly(F.col("spaced"))).alias("plain"))
    # (length, exact, is_whole, keys) of each kind of window; a text's are put in a row, and told apart by where they stand.
    made = made.select("doc", "words", "plain", "clauses", (_tokens(F.lower("parts"), PLAIN) if short else none).alias("marked"))
    made = _with_pairs(_with_pairs(made, "plain", [n for _, n in exact]), "words", [n for _, n in template])
    each = [(n, True, False, _keys("plain", n)) for _, n in exact]
    each += [(n, True, True, _whole_keys(F.col("marked"), _keys("plain", n), n)) for n in short]
    each += [(n, False, False, _keys("words", n)) for _, n in template if n]
    each += [(0, False, False, F.transform("clauses", lambda c: F.xxhash64(F.trim(c))))] if whole_clauses else []
    if not each:
        each = [(1, True, False, F.array().cast("array<bigint>"))]
    made = made.select("doc", *[keys.alias(f"keys{k}") for k, (*_, keys) in enumerate(each)])
    sizes = [F.size(f"keys{k}") for k in range(len(each))]
    made = made.select("doc", *[f"keys{k}" for k in range(len(each))], *[sum(sizes[:k], F.lit(0)).alias(f"from{k}") for k in range(len(each))])
    made = made.select("*", F.posexplode(F.concat(*[F.col(f"keys{k}") for k in range(len(each))])).alias("nth", "key"))

    def told(value) -> Column:  # noqa: ANN001
        """A value by the kind of window that a place is of."""
        out = value(0, *each[0][:3])
        for k in range(1, len(each)):
            out = F.when(F.col("nth") >= F.col(f"from{k}"), value(k, *each[k][:3])).otherwise(out)
        return out

    at = lambda k: F.col("nth") - F.col(f"from{k}")
    made = made.select(
        "doc",
        "key",
        told(lambda k, n, *_: at(k) + 1 if n else -at(k)).alias("pos"),
        told(lambda k, n, *_: F.lit(n)).alias("length"),
        told(lambda k, n, exact, _: F.lit(exact)).alias("exact"),
        told(lambda k, n, exact, whole: F.lit(whole)).alias("is_whole"),
        told(lambda k, n, exact, _: F.get(f"keys{k}", at(k) + window) if n == window and not exact else F.lit(None).cast("bigint")).alias("then"),
    )
    # Hashes alone are the key, which is looked up quickest; the kind of window is compared then.
    keys = _small(probes, F.lit(36))
    alike = (F.col("length") - F.col("_length") == 0) & (F.col("exact").cast("int") - F.col("_exact").cast("int") == 0)
    behind = F.coalesce(F.col("then") == F.col("_then"), F.col("_then").isNull())
    places = made.join(keys, (F.col("key") == F.col("_key")) & alike & behind).where(~F.col("whole") | F.col("is_whole"))
    places = cut(places.select("doc", "pos", F.col("full").alias("length"), "exact", "is_whole"))
    suspects = places.select(F.col("doc").alias("_doc")).distinct()
    again = rows.join(_small(suspects, F.lit(32)), F.col("doc").eqNullSafe(F.col("_doc")), "left_semi")
    again = worded(again).select(
        "doc",
        "words",
        (_tokens(F.lower("parts"), PLAIN) if exact else none).alias("plain"),
        (_tokens(_flat(F.col("slotted"))) if template else none).alias("tokens"),
        (_clauses(F.col("slotted")) if whole_clauses else none).alias("said"),
    )
    part = lambda c: F.slice(c, F.col("pos"), F.col("length"))
    held = again.join(places.withColumnRenamed("doc", "_doc"), F.col("doc").eqNullSafe(F.col("_doc")))
    clause, in_clause = F.get("said", -F.col("pos")), F.col("length") == 0
    words = F.when(in_clause, _canonical(clause)).when(F.col("exact"), _unmarked(part(F.col("plain")))).otherwise(part(F.col("words")))
    slots = F.when(F.col("exact"), _no_slots()).otherwise(_slots(F.when(in_clause, _tokens(clause)).otherwise(part(F.col("tokens")))))
    return held.select("doc", "exact", "is_whole", in_clause.alias("clause"), words.alias("words"), slots.alias("slots")).distinct()


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(doc, item, pos, exact) of every window found, and all windows."""
    bench = cut(item_windows(benchmark, item_col, item_text, window))
    found = _found(docs, bench, id_col, text_col, window)
    right = bench.select("item", "pos", "exact", "whole", (F.col("length") == 0).alias("clause"), "words", "slots")
    size = F.octet_length(F.array_join("words", " ")) + 8 * F.size("slots") + 65
    sure = found.join(_small(right, size), ["exact", "clause", "words", "slots"]).where(~F.col("whole") | F.col("is_whole"))
    return sure.select("doc", "item", "pos", "exact"), bench


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document id and item that share a window: id, item_id, n_windows (the item's windows and clauses found), coverage (of the item's windows, or of its clauses if that is more).

    Null texts are empty; texts without words match nothing; null ids are carried; rows that repeat an id are one document with several texts, and
    items that share an id one item. Empty tables give an empty result. Other columns are not looked at.
    """
    sure, bench = _leaks(docs, benchmark, id_col, text_col, item_col, item_text, window)
    inside = F.when(F.col("pos") > 0, F.struct("pos", "exact"))
    clauses = F.when(F.col("pos") < 0, F.col("pos"))
    totals = bench.groupBy("item").agg(F.countDistinct(inside).alias("_of"), F.countDistinct(clauses).alias("_of_clauses"))
    per = sure.groupBy(F.col("doc.id").alias("id"), "item").agg(F.countDistinct(inside).alias("_n"), F.countDistinct(clauses).alias("_n_clauses"))
    coverage = F.greatest(F.try_divide("_n", "_of"), F.try_divide("_n_clauses", "_of_clauses"))
    return per.join(totals, "item").select(F.col("id").alias(id_col), F.col("item.id").alias(item_col), (F.col("_n") + F.col("_n_clauses")).alias("n_windows"), coverage.alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text shares no window with the benchmark, columns unchanged; of texts that share an id each goes by itself."""
    sure, _ = _leaks(docs, benchmark, id_col, text_col, "item_id", "text", WINDOW)
    gone = cut(sure.select(F.col("doc.id").alias("_id"), F.col("doc.th").alias("_th")).distinct())
    few = _small(gone, F.lit(24))
    return docs.join(few, docs[f"`{id_col}`"].eqNullSafe(few["_id"]) & (F.xxhash64(filled(docs[f"`{text_col}`"])) == few["_th"]), "left_anti")
