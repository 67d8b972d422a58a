"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so a question whose parameters were exchanged keeps its template.
Windows of template tokens are hashed and joined between benchmark items and documents; an item counts as leaked when
its matched windows cover enough of it, and when the values in its slots map consistently to those of the document.
Items too short for windows are joined by their whole skeleton; literal copies in any case are found beside that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import written

# possessive groups: the same matches, but long runs of names or numbers do not overflow the stack
NUMBER = r"[0-9]+(?:[.,:][0-9]+)*+"
NAME = r"\p{Lu}[\p{L}\p{M}]*(?:\s+\p{Lu}[\p{L}\p{M}]*)*+"
#: as many capitalised words in a row as a window has tokens: canonical() makes them one placeholder
CAPITALS = r"(?:\p{Lu}[\p{L}\p{M}]*+\P{L}{1,9}+){4}\p{Lu}"
# scripts without spaces count by character
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
LITERAL = rf"[{UNSPACED}]|[\p{{L}}\p{{M}}&&[^{UNSPACED}]]+|[0-9]+(?:[.,:][0-9]+)*+|[\p{{Sm}}*/^%-]"
#: fixed values: unit words of the languages of the documents (en, fr, de, es)
UNITS = """
mm cm km kg mg g ml l kwh mph kmh hz khz mhz ghz kb mb gb tb percent dollars euros pounds cents meters metres miles feet
inches hours minutes seconds days weeks months years degrees grams liters litres
pour\\s+cent livres mètres kilomètres grammes heures secondes jours semaines mois ans années degrés
prozent euro dollar pfund meter kilometer gramm liter stunden minuten sekunden tage tagen wochen monate monaten jahre jahren grad
por\\s+ciento dólares libras metros kilómetros gramos litros horas minutos segundos días semanas meses años grados
""".split()


#: fixed values: number words of the same languages, which count as numbers in short questions
NUMBER_WORDS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen
nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand
zéro un deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante
soixante cent mille
null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig
neunzig hundert tausend
cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta
sesenta setenta ochenta noventa cien mil
""".split()


def canonical(text: Column) -> Column:
    """Template tokens of a whole text: words in lower case, <n> for numbers, <n> <u> for a number with its unit, <p> for
    runs of capitalised words (sentence starts included, alike on both sides)."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), NAME, " <p> ")
    c = F.regexp_replace(c, NUMBER, " <n> ")
    c = F.regexp_replace(F.lower(c), rf"<n>\s+(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}])", "<n> <u>")
    return F.filter(F.split(c, r"[^\p{L}\p{M}<>]+"), lambda w: w != "")


def slots(text: Column) -> Column:
    """Values of the name and number slots in order, by type."""
    body = F.coalesce(text, F.lit(""))
    return F.struct(F.regexp_extract_all(body, F.lit(NAME), F.lit(0)).alias("p"), F.regexp_extract_all(body, F.lit(NUMBER), F.lit(0)).alias("n"))


def hashed(tokens: Column, window: int) -> Column:
    """Hash of each window of tokens."""

    def of(t: Column) -> Column:
        at = F.when(F.size(t) >= window, F.sequence(F.lit(1), F.size(t) - window + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda k: F.xxhash64(F.slice(t, k, window)))

    # the lambda's argument is a value: without it the tokens would be made anew for every window
    return F.transform(F.array(tokens), of)[0]


def covered(places: Column, window: int) -> Column:
    """Tokens that windows at the given sorted places cover."""
    later = F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0)))
    steps = F.transform(F.arrays_zip(F.slice(places, 1, F.size(later)).alias("a"), later.alias("b")), lambda s: F.least(s["b"] - s["a"], F.lit(window)))
    return F.aggregate(steps, F.lit(window), lambda acc, s: acc + s)


def literal(text: Column) -> Column:
    """Words, numbers and operators of a whole text in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LITERAL), F.lit(0))


def skeleton(tokens: Column) -> Column:
    """Literal tokens with <n> for numbers, in digits or words."""
    return F.transform(tokens, lambda w: F.when(w.rlike("^[0-9]") | w.isin(*NUMBER_WORDS), "<n>").otherwise(w))


def plain(tokens: Column) -> Column:
    """Number of tokens that are no placeholder."""
    return F.size(F.filter(tokens, lambda w: ~w.isin("<n>", "<p>", "<u>")))


def share(places: Column, window: int, n: Column) -> Column:
    """Share of n tokens that windows at the given sorted places cover."""
    return F.when(F.size(places) > 0, covered(places, window) / n).otherwise(F.lit(0.0))


def copies(d: DataFrame, items: DataFrame, window: int, similarity: float, broadcast_rows: int) -> DataFrame:
    """Leaked items by their literal tokens, at one place of the document: (doc_id, item_id, similarity, consistency, reworded).
    Items shorter than a window are looked up whole."""

    def windows(t: Column, sizes) -> Column:
        def of_size(t: Column, w: int) -> Column:
            return F.transform(hashed(t, w), lambda h, k: F.struct(F.lit(w).alias("w"), k.alias("at"), h.alias("h")))

        return F.transform(F.array(t), lambda t: F.concat(*[of_size(t, w) for w in sizes]))[0]

    b = written(items.select("item_id", literal(F.col("item_text")).alias("t")).where(F.size("t") > 1).withColumn("least", F.least(F.size("t"), F.lit(window))))
    sizes = sorted(r[0] for r in b.select("least").distinct().collect()) or [window]
    side = b.select("item_id", "least", F.size("t").alias("n"), F.explode(windows(F.col("t"), sizes)).alias("g")).where("g.w = least").select("item_id", "n", F.col("g.w").alias("w"), F.col("g.at").alias("item_at"), F.col("g.h").alias("h"))
    each = d.select("doc_id", "copy", F.explode(windows(literal(F.col("text")), sizes)).alias("g")).select("doc_id", "copy", "g.w", "g.at", "g.h")
    met = each.join(F.broadcast(side) if side.count() <= broadcast_rows else side, ["w", "h"])
    runs = met.groupBy("doc_id", "copy", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.first("n").alias("n"), F.first("w").alias("w"), F.sort_array(F.collect_set("item_at")).alias("places"))
    best = runs.withColumn("similarity", F.when(F.col("w") < window, 1.0).otherwise(share(F.col("places"), window, F.col("n")))).where(F.col("similarity") >= similarity).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))
    return best.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), F.lit(1.0).alias("consistency"), (F.col("similarity") < 1).alias("reworded"))


def short_templates(d: DataFrame, items: DataFrame, head: int, longest: int, consistency: float, broadcast_rows: int) -> DataFrame:
    """Leaked items of at most `longest` literal tokens whose numbers may differ, of which at least three are no number:
    the whole skeleton, operators included, stands at one place. Found by its first `head` tokens, then verified there
    with the values of its slots. Columns as in copies()."""
    t = items.select("item_id", literal(F.col("item_text")).alias("t")).withColumn("k", skeleton(F.col("t")))
    spoken = F.size(F.filter("k", lambda w: w != "<n>"))
    t = written(t.where(F.size("k").between(head, longest) & (spoken >= 3) & F.array_contains("k", "<n>")).withColumn("h", F.xxhash64(F.slice("k", 1, head))))
    side = t.select("item_id", "h", F.size("k").alias("n"))
    each = d.select("doc_id", "copy", F.posexplode(hashed(skeleton(literal(F.col("text"))), head)).alias("at", "h"))
    met = written(each.join(F.broadcast(side) if side.count() <= broadcast_rows else side, "h").groupBy("doc_id", "copy").agg(F.collect_list(F.struct("item_id", "at", "n")).alias("met")))
    texts = d.join(met.select("doc_id", "copy"), ["doc_id", "copy"], "left_semi").groupBy("doc_id", "copy").agg(literal(F.min("text")).alias("tokens"))
    there = texts.join(met, ["doc_id", "copy"]).select("doc_id", F.explode(F.transform("met", lambda m: F.struct(m["item_id"].alias("item_id"), F.slice("tokens", m["at"] + 1, m["n"]).alias("there")))).alias("m")).select("doc_id", "m.*")
    full = there.join(t, "item_id").where(skeleton(F.col("there")) == F.col("k"))
    slot = F.filter(F.arrays_zip("k", F.col("t").alias("a"), F.col("there").alias("b")), lambda s: s["k"] == "<n>")
    kinds, ways = F.size(F.array_distinct(F.transform(slot, lambda s: s["a"]))), F.size(F.array_distinct(F.transform(slot, lambda s: F.struct(s["a"], s["b"]))))
    full = full.withColumn("consistency", F.round(kinds / ways, 6)).where(F.col("consistency") >= consistency)
    return full.select("doc_id", "item_id", F.lit(1.0).alias("similarity"), "consistency", (F.col("t") != F.col("there")).alias("reworded"))


def leaks(docs: DataFrame, items: DataFrame, window: int = 5, similarity: float = 0.8, consistency: float = 0.8, slack: int = 8, broadcast_rows: int = 2_000_000, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per leaked item and document: doc_id, item_id, similarity (covered share of the item's template tokens),
    consistency (share of slot values that map to one value of the document), reworded (a slot differs).

    The windows of a match lie at one place of the document: their shifts against the item differ by at most `slack`
    (as many words may stand between them), never by more than twice that.

    All windows of an item count. Those of mostly placeholders stand in too many documents to be looked up alone: they
    count where the document goes on with them beside a window of words, or, for items that such windows nearly cover,
    where one alignment holds as many plain words as a window of words has.

    In texts with runs of capitalised words, which are one placeholder, all items are compared by their literal tokens in
    lower case as well (similarity is the covered share of these, reworded that one differs). So are, in all texts, items
    with fewer template tokens than a window or fewer plain words than that; whole where they are shorter than a window.
    Such items of at most 16 literal tokens are also found with other numbers, by their whole skeleton of words, operators
    and numbers, of which three are words or operators. Longer ones of hardly any words are found by their literal tokens
    alone, so not with other numbers. Items of a single literal token,
    which are no question but a word of any text, null texts and rows without ids match nothing. Rows that repeat a doc_id are compared text by text, and their best match
    counts; of items that repeat an id the smallest text counts. Other columns are left out, whatever their names; empty
    tables give an empty table. The item windows are broadcast only while they are at most broadcast_rows (about
    50 MB), else joined by a shuffle; each window of the whole documents is looked up either way.
    """
    b = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("item_text")).where("item_id is not null and item_text is not null")
    b = b.groupBy("item_id").agg(F.min("item_text").alias("item_text")).withColumn("item_tokens", canonical(F.col("item_text")))
    b = written(b.withColumn("template", F.xxhash64("item_tokens")))
    few = (F.size("item_tokens") < window) | (plain(F.col("item_tokens")) * 2 < window)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    every, short = b, written(b.where(few))
    b = b.where(~few)
    n = F.size("item_tokens")
    t = b.groupBy("template").agg(F.first("item_tokens").alias("item_tokens")).withColumn("words", F.transform(F.sequence(F.lit(1), n - window + 1), lambda k: plain(F.slice("item_tokens", k, window))))
    t = t.withColumn("heavy", F.filter(F.sequence(F.lit(0), n - window), lambda k: F.get("words", k) * 2 < window))
    t = written(t.withColumn("bare", share(F.col("heavy"), window, n) >= similarity))
    grams = t.select("template", "bare", F.posexplode(F.arrays_zip(hashed(F.col("item_tokens"), window).alias("h"), F.col("words").alias("w"))).alias("item_at", "g"))
    grams = grams.select("template", "item_at", F.col("g.h").alias("h"), (F.col("g.w") * 2 >= window).alias("firm"), "bare", F.col("g.w").alias("w")).where("firm or (bare and w > 0)").drop("w")
    each = d.select("doc_id", "copy", F.posexplode(hashed(canonical(F.col("text")), window)).alias("at", "h"))
    side = F.broadcast(grams) if grams.count() <= broadcast_rows else grams
    met = each.join(side, "h").withColumn("shift", F.col("at") - F.col("item_at"))
    firm = lambda c: F.when(F.col("firm"), F.col(c))
    # two gauges, half a step apart: shifts that differ by at most `slack` fall together in one of them
    gauges = F.array(*[F.struct(F.lit(k).alias("gauge"), F.floor((F.col("shift") + k * slack) / (2 * slack)).alias("mark")) for k in (0, 1)])
    met = met.withColumn("place", F.explode(gauges))
    pairs = met.groupBy("doc_id", "copy", "template", "place").agg(
        F.sort_array(F.collect_set(firm("item_at"))).alias("places"), F.mode(firm("shift"), True).alias("shift"), F.collect_set(firm("shift")).alias("shifts"), F.collect_set(F.when(F.col("bare"), F.col("shift"))).alias("alone")
    )
    held = pairs.join(t.select("template", "heavy", "bare", n.alias("item_n")), "template")
    pairs = written(held.where(F.col("bare") | (share(F.array_sort(F.array_union("places", "heavy")), window, F.col("item_n")) >= similarity)))
    # slot values only of documents that share a template; ids repeat in no pair, so text joins stay one to one
    texts = d.join(pairs.select("doc_id", "copy").distinct(), ["doc_id", "copy"], "left_semi").groupBy("doc_id", "copy").agg(F.min("text").alias("text"))
    full = pairs.join(texts, ["doc_id", "copy"]).join(b, "template")
    full = full.withColumn("doc_tokens", canonical(F.col("text"))).withColumn("ds", slots(F.col("text"))).withColumn("bs", slots(F.col("item_text")))
    full = written(full.drop("text", "item_text"))

    def at_shift(p: Column, s: Column) -> Column:
        return F.when(p + s >= 0, F.slice("doc_tokens", F.greatest(p + s + 1, F.lit(1)), window) == F.slice("item_tokens", p + 1, window)).otherwise(False)

    def told(sim: Column, shift: Column, places: Column, joint: int) -> Column:
        return F.struct(sim.alias("similarity"), F.lit(joint).alias("joint"), (-shift).alias("back"), places.alias("places"))

    def alone(s: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.col("item_n") - window), lambda p: at_shift(p, s))
        spoken = F.filter(F.sequence(F.lit(0), F.col("item_n") - 1), lambda q: F.exists(places, lambda p: (p <= q) & (q < p + window)))
        enough = plain(F.transform(spoken, lambda q: F.get("item_tokens", q))) * 2 >= window
        return told(F.when(enough, share(places, window, F.col("item_n"))).otherwise(0.0), s, places, 0)

    beside = F.array_sort(F.array_union("places", F.filter("heavy", lambda p: F.exists("shifts", lambda s: at_shift(p, s)))))
    # struct of the best: several shifts around windows of words, or one shift alone
    full = full.withColumn("beside", beside).withColumn("ways", F.concat(F.array(told(share(F.col("beside"), window, F.col("item_n")), F.col("shift"), F.col("beside"), 1)), F.transform("alone", alone)))
    full = full.withColumn("best", F.array_max("ways")).where(F.col("best.similarity") >= similarity)
    full = full.withColumn("similarity", F.col("best.similarity")).withColumn("shift", -F.col("best.back"))
    full = full.withColumn("lo", F.element_at("best.places", 1)).withColumn("hi", F.element_at("best.places", -1) + window)
    full = written(full.select("doc_id", "item_id", "similarity", "shift", "lo", "hi", "item_tokens", "doc_tokens", "ds", "bs"))

    def paired(kind: str) -> Column:
        tag = f"<{kind}>"
        count = lambda tokens, n: F.size(F.filter(F.slice(tokens, 1, F.greatest(n, F.lit(0))), lambda w: w == tag))
        first, last = count(F.col("item_tokens"), F.col("lo")), count(F.col("item_tokens"), F.col("hi"))
        mine = count(F.col("doc_tokens"), F.col("lo") + F.col("shift"))
        there = F.when(last > first, F.sequence(first + 1, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(there, lambda k: F.struct(F.lit(kind).alias("kind"), F.try_element_at(F.col(f"bs.{kind}"), k).alias("a"), F.try_element_at(F.col(f"ds.{kind}"), k - first + mine).alias("b")))

    full = full.withColumn("slot", F.concat(paired("p"), paired("n")))
    kinds = F.size(F.array_distinct(F.transform("slot", lambda s: F.struct(s["kind"], s["a"]))))
    ways = F.size(F.array_distinct("slot"))
    out = full.select(
        "doc_id",
        "item_id",
        F.round("similarity", 6).alias("similarity"),
        F.round(F.when(ways == 0, 1.0).otherwise(kinds / ways), 6).alias("consistency"),
        F.exists("slot", lambda s: ~s["a"].eqNullSafe(s["b"])).alias("reworded"),
    )
    out = out.where(F.col("consistency") >= consistency).unionByName(copies(d.where(F.col("text").rlike(CAPITALS)), every, window, similarity, broadcast_rows))
    if not short.isEmpty():
        out = out.unionByName(copies(d, short, window, similarity, broadcast_rows)).unionByName(short_templates(d, short, 4, 16, consistency, broadcast_rows))
    # of several places and ways the most alike
    best = F.max(F.struct("similarity", "consistency", (~F.col("reworded")).alias("same"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.similarity", "best.consistency", (~F.col("best.same")).alias("reworded"))
