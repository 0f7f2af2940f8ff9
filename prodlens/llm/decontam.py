"""Benchmark decontamination by template canonicalisation (DataFrame functions
only on the main path).

A text becomes a list of tokens: numbers, names (runs of capitalised words)
and units are typed placeholders, other words are lower-cased, everything else
separates. Windows of ``width`` tokens of the benchmark's templates are
hash-joined with the windows of every document, so a question whose numbers
or names were exchanged still meets its original.

Beside them, windows of plain tokens are hash-joined (the exact path): no
placeholders, a number, a letter run or one letter of a script without blanks
is a token, and every window of an item is searched whatever it is made of.
``fold_case`` joins them without regard to letter case (the registered
queries set it). A text found by this path only is reported with its plain
tokens, as verbatim and without slots.

Texts with a hit are then aligned token by token: hits of one benchmark item
on one diagonal (document position minus item position) belong together. An
alignment must cover ``min_tokens`` tokens or the share ``min_share`` of the
item, and either its exchanged slot values are consistent (each value of the
item that was exchanged stands against one and the same value of the document;
slots that kept their value need no agreement), or it has that many tokens
word for word in one run. A number's or unit's value is judged together with
the token after it, as two quantities may share a value by chance ("2 apples
and 2 pears"); a name is judged by itself.

With ``fold_case`` a third, loose path finds questions whose letter case is gone
too, whose numbers are spelled out, or whose names have other lengths. There,
number words are numbers, the word after a number is its unit whatever it is,
and only the item says where names stand: a name of the item may meet one to
four words. Tiles of at most ``TILE`` tokens between the names are hash-joined
at their runs of literal words, and the item is laid out from there to both
sides, tile by tile. The same rules then judge the alignment.

Every window of all paths holds a gram (up to ``GRAM`` words or numbers in a
row, in lower case) that a text with the window must hold as well. So all texts
are first searched for one gram of each window, in generated code without
lambdas, and only texts with a gram go through the paths. A window without any
letter or digit has no gram; then all texts go through.

Scale: documents are a map (tokens, gram hashes) and a join with the
benchmark's grams, which are broadcast if their counted size is in bounds.
Only texts with a hit are read again, once per distinct text. No window is
sampled and no text is cut.

Edge cases: null and empty texts have no tokens and match nothing; an item
shorter than ``width`` tokens is one window of its own length; as templates,
items of fewer than ``MIN_WIDTH`` tokens and windows with fewer than
``MIN_WORDS`` words besides placeholders are too general and are only searched
by the exact path (so a one-word item is held by every text with that word); repeated items are all reported;
repeated documents are all reported; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prodlens.functions.core import let
from prodlens.llm.common import counted, hint_small, materialise, pick

MIN_WIDTH, MIN_WORDS = 5, 4
#: Tokens of a gram, tokens of a loose tile, words that a name may meet.
GRAM, TILE, NAME_WORDS = 5, 4, 4

UNITS = ("km cm mm kg mg lb lbs oz ml mi mph kmh ft inch inches mile miles metre metres meter meters gram grams "
         "litre litres liter liters hour hours hr hrs minute minutes min second seconds sec day days week weeks "
         "month months year years dollar dollars usd euro euros eur cent cents percent pound pounds").split()

NAME = r"(?<!\p{L})\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*(?!\p{L})"
NUMBER = r"\d+(?:[.,:/]\d+)*"
UNIT = r"(?<!\p{L})(?i:" + "|".join(UNITS) + r")(?!\p{L})"
#: Scripts written without blanks: each letter is a token of the exact path.
DENSE = "".join(r"\p{Is%s}" % x for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
#: The first ranges are Latin letters: tested first, as the intersection is slow.
PLAIN = r"%s|[%s]|[a-zA-Z[\p{L}\p{M}&&[^%s]]]+" % (NUMBER, DENSE, DENSE)
GRAM_TOKEN = r"[a-z\u00DF-\u00F6\u00F8-\u00FF[\p{L}&&[^%s]]]++|%s|[%s]" % (DENSE, NUMBER, DENSE)
#: Words that the loose path reads as numbers (English; a run of them is one number).
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
                "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
                "million billion").split()
_SAID = "(?:%s)" % "|".join(NUMBER_WORDS)
SAID = r"(?<!\p{L})%s(?:(?:[ -]| and )%s)*(?!\p{L})" % (_SAID, _SAID)
#: Placeholders; U+0001 occurs in no token.
P_NAME, P_NUMBER, P_UNIT = "\x01p", "\x01n", "\x01u"


def template(text: Column) -> Column:
    """The text's tokens joined by blanks, slots as placeholders."""
    t = F.regexp_replace(text, NAME, " %s " % P_NAME)
    t = F.regexp_replace(t, NUMBER, " %s " % P_NUMBER)
    t = F.regexp_replace(t, UNIT, " %s " % P_UNIT)
    return F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\x01]+", " "))


def surfaces(text: Column) -> Column:
    """The same tokens as they stand in the text."""
    return F.regexp_extract_all(text, F.lit("%s|%s|%s" % (NAME, NUMBER, r"\p{L}+")), F.lit(0))


def token_of(surface: Column) -> Column:
    """Template token of a surface."""
    return (F.when(surface.rlike("^(?:%s)$" % NAME), F.lit(P_NAME))
            .when(surface.rlike(r"^\d"), F.lit(P_NUMBER))
            .when(surface.rlike("^(?:%s)$" % UNIT), F.lit(P_UNIT)).otherwise(F.lower(surface)))


def window_hashes(tokens: Column, width: int) -> Column:
    """Hash of every window of ``width`` tokens (an empty array if there is none)."""
    return let(tokens, lambda t: F.when(F.size(t) >= width, F.transform(
        F.sequence(F.lit(1), F.size(t) - (width - 1)), lambda i: F.xxhash64(F.slice(t, i, width)))))


def plain_tokens(text: Column, fold_case: bool) -> Column:
    """The text's tokens for the exact path."""
    return F.regexp_extract_all(F.lower(F.upper(text)) if fold_case else text, F.lit(PLAIN), F.lit(0))


def plain_windows(bench: DataFrame, width: int, item: str, text: str, fold_case: bool) -> DataFrame:
    """(item_id, n, w, ipos, btokens, h): all windows of the items' plain tokens."""
    b = bench.select(pick(bench, item, "long").alias("item_id"), plain_tokens(pick(bench, text, "string"), fold_case).alias("t"))
    b = b.where(F.size("t") > 0).withColumn("n", F.size("t")).withColumn("w", F.least(F.col("n"), F.lit(width)))
    b = b.select("item_id", "n", "w", "t", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("w") + 1)).alias("ipos"))
    b = b.select("item_id", "n", "w", "ipos", F.slice("t", F.col("ipos"), F.col("w")).alias("btokens"))
    return b.withColumn("h", F.xxhash64("btokens"))


def plain_matches(c: DataFrame, pw: DataFrame, n: int, widths: list[int], enough) -> DataFrame:
    """Rows of ``matches`` for texts ``c`` (text_key, p) that hold an item's plain tokens."""
    at = None
    for w in widths:
        x = c.where(F.size("p") >= w).select("text_key", "p", F.explode(F.sequence(F.lit(1), F.size("p") - (w - 1))).alias("pos"))
        x = x.select("text_key", "pos", F.slice("p", F.col("pos"), w).alias("dtokens")).withColumn("h", F.xxhash64("dtokens"))
        at = x if at is None else at.unionByName(x)
    j = at.join(hint_small(pw, n, 32 * max(widths)), "h").where("dtokens = btokens")
    places = F.explode(F.sequence(F.col("ipos"), F.col("ipos") + F.col("w") - 1))
    out = (j.select("text_key", "item_id", "n", (F.col("pos") - F.col("ipos")).alias("diag"), places.alias("place")).distinct()
           .groupBy("text_key", "item_id", "n", "diag").agg(F.count(F.lit(1)).alias("matched_tokens")))
    out = out.where(enough(F.col("matched_tokens")))
    return out.groupBy("text_key", "item_id", F.col("n").alias("item_tokens")).agg(F.max("matched_tokens").alias("matched_tokens")).select(
        "text_key", "item_id", "matched_tokens", "item_tokens", F.lit(0).cast("long").alias("n_slots"), F.lit(True).alias("verbatim"))


# -------------------------------------------------------------- first search
def gram_tokens(text: Column) -> Column:
    """Words and numbers of a text in lower case; what other patterns split or
    join inside a word is split here."""
    return F.regexp_extract_all(F.lower(text), F.lit(GRAM_TOKEN), F.lit(0))


def best_grams(runs: DataFrame) -> DataFrame:
    """``runs`` with (h, k) of each run of tokens (``text``): its gram of up to
    ``GRAM`` tokens with the most characters; h is null for a run without tokens."""
    r = runs.withColumn("q", gram_tokens(F.col("text"))).withColumn("k", F.least(F.size("q"), F.lit(GRAM)))
    grams = F.transform(F.sequence(F.lit(1), F.size("q") - F.col("k") + 1), lambda i: F.slice("q", i, F.col("k")))
    best = F.array_max(F.transform(grams, lambda g: F.struct(F.length(F.concat_ws("", g)).alias("chars"), F.xxhash64(g).alias("h"), g.alias("g"))))
    r = r.withColumn("b", F.when(F.col("k") > 0, best))
    return r.withColumn("h", F.when(F.col("k") > 0, F.xxhash64("b.g"))).drop("q", "b", "text")


def needed_grams(windows: DataFrame, min_tokens: int, min_share: float) -> DataFrame:
    """(h, k): the grams to search for of ``windows`` (item_id, n, w, ipos,
    text). An alignment of an item covers ``min_tokens`` or the share
    ``min_share`` of it; so windows with short grams, which many texts hold,
    may be passed over as far as all those of an item cover less than that:
    an alignment then has another window, too."""
    g = materialise(best_grams(windows))
    place = F.explode(F.sequence("ipos", F.col("ipos") + F.col("w") - 1)).alias("place")
    first = g.select("item_id", "n", place, "k").groupBy("item_id", "n", "place").agg(F.min("k").alias("k"))
    cover = first.groupBy("item_id", "n").agg(*[F.count(F.when(F.col("k") < k, 1)).alias("c%d" % k) for k in range(2, GRAM + 1)])
    enough = lambda c: (c >= min_tokens) | (c >= min_share * F.col("n"))
    least = F.lit(1)
    for k in range(2, GRAM + 1):
        least = F.when(~enough(F.col("c%d" % k)), F.lit(k)).otherwise(least)
    least = cover.select(F.col("item_id").alias("i"), F.col("n").alias("m"), least.alias("least"))
    j = g.join(hint_small(least, least.count(), 24), F.col("item_id").eqNullSafe(F.col("i")) & (F.col("n") == F.col("m")))
    return j.where("h is null or k >= least").select("h", "k").distinct()


def literal_runs(windows: DataFrame, tokens: str) -> DataFrame:
    """``windows`` with ``text``: the longest run of tokens that aren't placeholders."""
    cut = F.transform(tokens, lambda x: F.when(x.startswith("\x01"), F.lit("\x01")).otherwise(x))
    runs = F.split(F.concat_ws("\x02", cut), "\x01")
    sized = F.transform(runs, lambda x: F.struct(F.size(F.filter(F.split(x, "\x02"), lambda w: w != "")).alias("n"), F.length(x).alias("c"), x.alias("x")))
    return windows.withColumn("text", F.translate(F.array_max(sized)["x"], "\x02", " "))


def places(tokens: Column) -> Column:
    """A row for each place of an array, counted from 0."""
    return F.explode(F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)))


def first_grams(bw: DataFrame, pw: DataFrame, min_tokens: int, min_share: float) -> DataFrame:
    """(h, k): grams of the template and plain windows."""
    place = ("item_id", "n", "w", "ipos")
    a = literal_runs(bw, "btokens").select(*place, "text")
    b = pw.select(*place, F.concat_ws(" ", "btokens").alias("text"))
    return needed_grams(a, min_tokens, min_share).union(needed_grams(b, min_tokens, min_share)).distinct()


def texts_with_grams(d: DataFrame, grams: DataFrame) -> DataFrame:
    """The texts of ``d`` (text, text_key) that hold one of ``grams`` (h, k)."""
    grams, n = counted(grams)
    if grams.where("h is null").limit(1).count():
        return d
    sizes = sorted(r["k"] for r in grams.select("k").distinct().collect())  # at most GRAM numbers
    q, p = F.col("q"), F.col("p")
    x = d.select("text_key", gram_tokens(F.col("text")).alias("q"))
    x = x.select("text_key", "q", places(q).alias("p"))  # a filter on the size would make the tokens twice
    # the hash of some columns is that of their array
    hashes = [F.when(p + k <= F.size(q), F.xxhash64(*[F.get(q, p + i) for i in range(k)])) for k in sizes]
    if not hashes:
        return d.limit(0)
    x = x.select("text_key", (hashes[0] if len(hashes) == 1 else F.explode(F.array(*hashes))).alias("h"))
    hit, n_hit = counted(x.join(hint_small(grams.select("h"), n, 16), "h", "left_semi").select("text_key").distinct())
    return d.join(hint_small(hit, n_hit, 16), "text_key", "left_semi")


# ---------------------------------------------------------------- loose path
def _loose(surfaces: Column, name: bool) -> Column:
    """Loose tokens of surfaces; names are told by capitals if ``name``."""
    def kind(x: Column) -> Column:
        number = x.rlike(r"^\d") | (F.lower(F.substring_index(F.substring_index(x, " ", 1), "-", 1)).isin(*NUMBER_WORDS) & F.lower(x).rlike("^%s$" % SAID))
        k = F.when(number, F.lit(P_NUMBER))
        return (k.when(x.rlike("^(?:%s)$" % NAME), F.lit(P_NAME)) if name else k).otherwise(F.lower(x))
    # the word after a number is a unit
    return let(F.transform(surfaces, kind), lambda t: F.zip_with(
        t, F.concat(F.array(F.lit("")), F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))),
        lambda x, before: F.when((before == P_NUMBER) & ~x.startswith("\x01"), F.lit(P_UNIT)).otherwise(x)))


def loose_tiles(bench: DataFrame, item: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The items' tiles in order (iid, item_id, n, tile, ipos, names, name, toks,
    surf): ``names`` counts the names just before a tile, ``name`` is their text;
    and grams to look for (iid, tile, off, k, gram): the longest run of literal
    words, up to ``GRAM``, of each part between names, if no part has a longer one."""
    pattern = "(?i:%s)|%s|%s|%s" % (SAID, NAME, NUMBER, r"\p{L}+")
    b = bench.select(pick(bench, item, "long").alias("item_id"), F.regexp_extract_all(pick(bench, text, "string"), F.lit(pattern), F.lit(0)).alias("s"))
    b = b.where(F.size("s") >= MIN_WIDTH).distinct().withColumn("iid", F.xxhash64("item_id", "s"))
    b = b.select("iid", "item_id", F.size("s").alias("n"), F.posexplode(F.arrays_zip(_loose(F.col("s"), True).alias("t"), F.col("s").alias("s"))).alias("ipos", "z"))
    b = b.select("iid", "item_id", "n", "ipos", "z.t", "z.s", (F.col("z.t") == P_NAME).cast("int").alias("p"))
    w = Window.partitionBy("iid").orderBy("ipos")  # an item is one task: a text of the benchmark
    b = b.withColumn("seg", F.sum("p").over(w))
    b = b.withColumn("before", F.coalesce(F.max(F.when(F.col("p") == 0, F.col("ipos"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    b = materialise(b)
    names = b.where("p = 1").groupBy("iid", F.col("before").alias("last")).agg(
        F.count(F.lit(1)).cast("int").alias("names"), F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("ipos", "s"))), lambda x: F.lower(x["s"]))).alias("name"))
    t = b.where("p = 0").withColumn("r", F.row_number().over(Window.partitionBy("iid", "seg").orderBy("ipos")) - 1)
    t = t.groupBy("iid", "item_id", "n", "seg", F.floor(F.col("r") / TILE).alias("part")).agg(
        F.min("ipos").alias("ipos"), F.min("before").alias("last"), F.sort_array(F.collect_list(F.struct("ipos", "t", "s"))).alias("z"))
    t = t.join(names, ["iid", "last"], "left")
    t = t.withColumn("names", F.when(F.col("part") == 0, F.coalesce("names", F.lit(0))).otherwise(0)).withColumn(
        "tile", F.row_number().over(Window.partitionBy("iid").orderBy("ipos")) - 1)
    t = materialise(t.select("iid", "item_id", "n", "seg", "tile", "ipos", "names", "name", F.col("z.t").alias("toks"), F.transform("z.s", F.lower).alias("surf")))

    g = b.where("p = 0").groupBy("iid", "seg").agg(F.min("ipos").alias("start"), F.transform(F.sort_array(F.collect_list(F.struct("ipos", "t"))), lambda x: x["t"]).alias("t"))

    def run(i: Column) -> Column:  # the literal words from place i on
        part = F.slice("t", i + 1, GRAM)
        slots = F.array_position(F.transform(part, lambda x: x.startswith("\x01")), True)
        return let(F.slice("t", i + 1, F.when(slots > 0, slots.cast("int") - 1).otherwise(F.size(part))), lambda x: F.struct(
            F.size(x).alias("k"), F.length(F.concat_ws("", x)).alias("chars"), (-i).alias("back"), x.alias("gram")))
    g = g.select("iid", "seg", "start", F.array_max(F.transform(F.sequence(F.lit(0), F.size("t") - 1), run)).alias("g"))
    g = g.select("iid", F.col("seg").alias("gseg"), (F.col("start") - F.col("g.back")).alias("at"), "g.k", "g.gram",
                 F.max("g.k").over(Window.partitionBy("iid")).alias("most")).where("k > 0 and k = most")
    g = g.join(t.select("iid", "seg", "tile", "ipos", F.size("toks").alias("size")), "iid")
    g = g.where("seg = gseg and at >= ipos and at < ipos + size").select("iid", "tile", (F.col("at") - F.col("ipos")).alias("off"), "k", "gram")
    return t, materialise(g)


def _lay(tiles: Column, text: Column, start: Column, back: bool) -> Column:
    """Places of ``tiles`` in ``text`` one after the other from ``start`` on
    (to the left if ``back``): a tile's place, or null where it isn't found; a
    miss goes on as if the tile stood at its shortest distance."""
    zero = F.struct(start.alias("cur"), F.array().cast("array<struct<tile:int,at:int,gap:int>>").alias("found"))

    def step(a: Column, t: Column) -> Column:
        size = F.size(t["toks"])
        lo, hi = t["gap"], t["gap"] * NAME_WORDS

        def place(g: Column) -> Column:
            return a["cur"] - g - size if back else a["cur"] + g
        fits = F.filter(F.sequence(lo, hi), lambda g: (place(g) >= 0) & (F.slice(text, F.greatest(place(g), F.lit(0)) + 1, size) == t["toks"]))
        return let(F.get(fits, F.lit(0)), lambda g: let(place(F.coalesce(g, lo)), lambda at: F.struct(
            (at if back else at + size).alias("cur"),
            F.when(g.isNull(), a["found"]).otherwise(F.concat(a["found"], F.array(F.struct(t["tile"].alias("tile"), at.alias("at"), g.alias("gap"))))).alias("found"))))
    return F.aggregate(tiles, zero, step, lambda a: a["found"])


def loose_matches(c: DataFrame, tiles: DataFrame, grams: DataFrame, min_tokens: int, min_share: float) -> DataFrame:
    """Rows of ``matches`` for texts ``c`` (text_key, text) by the loose path."""
    c = c.select("text_key", F.regexp_extract_all(F.lower("text"), F.lit(r"%s|%s|\p{L}+" % (SAID, NUMBER)), F.lit(0)).alias("s"))
    c = materialise(c.select("text_key", "s", _loose(F.col("s"), False).alias("t")))
    n_tiles, n_grams = tiles.count(), grams.count()
    t, p = F.col("t"), F.col("p")
    at = c.select("text_key", "t", places(t).alias("p"))
    sizes = sorted(r["k"] for r in grams.select("k").distinct().collect()) or [1]  # at most GRAM numbers
    at = at.select("text_key", "t", "p", F.explode(F.array(*[
        F.when(p + k <= F.size(t), F.xxhash64(*[F.get(t, p + i) for i in range(k)])) for k in sizes])).alias("h"))
    # the tile of a gram has to stand there as a whole
    want = grams.join(tiles.select("iid", "tile", "toks"), ["iid", "tile"]).select("iid", "tile", "off", F.xxhash64("gram").alias("h"), "toks")
    hit = at.join(hint_small(want, n_grams, 64 * TILE), "h").where(
        (p >= F.col("off")) & (F.slice(t, F.greatest(p - F.col("off"), F.lit(0)) + 1, F.size("toks")) == F.col("toks")))
    hit = hit.select("text_key", "iid", "tile", (p - F.col("off")).alias("p")).distinct()

    line = F.sort_array(F.collect_list(F.struct("tile", "toks", F.col("names").alias("gap"))))
    items = tiles.groupBy("iid").agg(line.alias("line"))
    # to the left, the gap of a tile is that between it and its right neighbour
    items = items.withColumn("left", F.reverse(F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line")), lambda x, y: F.struct(
        x["tile"].alias("tile"), x["toks"].alias("toks"), y["gap"].alias("gap")))))
    j = hit.join(hint_small(items, n_tiles, 128 * TILE), "iid").join(c.select("text_key", "t"), "text_key")
    here = F.element_at("line", F.col("tile") + 1)
    right = F.slice("line", F.col("tile") + 2, F.size("line"))
    left = F.slice("left", F.size("line") - F.col("tile"), F.size("line"))
    found = F.concat(_lay(left, F.col("t"), F.col("p"), True), F.array(F.struct("tile", F.col("p").alias("at"), F.lit(0).alias("gap"))),
                     _lay(right, F.col("t"), F.col("p") + F.size(here["toks"]), False))
    # alignments that place the same tiles are one
    j = j.select("text_key", "iid", F.sort_array(F.transform(found, lambda x: F.struct(x["tile"].alias("tile"), x["at"].alias("at")))).alias("found"))
    j = j.distinct().withColumn("lay", F.xxhash64("found")).where(F.size("found") > 0)
    f = j.select("text_key", "iid", "lay", F.explode("found").alias("f")).select("text_key", "iid", "lay", "f.tile", "f.at")
    f = f.join(hint_small(tiles, n_tiles, 256 * TILE), ["iid", "tile"]).join(c.select("text_key", "s"), "text_key")
    w = Window.partitionBy("text_key", "iid", "lay").orderBy("tile")
    f = f.withColumn("pt", F.lag("tile").over(w)).withColumn("pe", F.lag(F.col("at") + F.size("toks")).over(w))
    named = (F.col("names") > 0) & (F.col("pt") == F.col("tile") - 1)
    said = F.concat_ws(" ", F.slice("s", F.col("pe") + 1, F.col("at") - F.col("pe")))
    own = F.transform(F.arrays_zip("toks", "surf", F.slice("s", F.col("at") + 1, F.size("toks")).alias("dsurf"),
                                   F.slice(F.concat("surf", F.array(F.lit(""))), 2, F.size("surf")).alias("next")),
                      lambda z: F.struct(z["toks"].alias("t"), z["surf"].alias("b"), z["dsurf"].alias("d"), z["next"].alias("next"), F.lit(1).alias("w")))
    with_name = F.when(named, F.concat(own, F.array(F.struct(F.lit(P_NAME).alias("t"), F.col("name").alias("b"), said.alias("d"),
                                                             F.lit("").alias("next"), F.col("names").alias("w"))))).otherwise(own)
    # a name before the first tile: the words there have to end like that name does elsewhere
    opening = F.when((F.col("tile") == 0) & (F.col("names") > 0), F.struct("name", F.concat_ws(
        " ", F.lit(""), F.slice("s", F.greatest(F.col("at") - NAME_WORDS, F.lit(0)) + 1, F.least("at", F.lit(NAME_WORDS)))).alias("words")))
    tok = f.select("text_key", "item_id", "n", "lay", opening.alias("opening"), F.explode(with_name).alias("z"))
    slot, same = F.col("z.t").startswith("\x01"), F.col("z.b") == F.col("z.d")
    exchanged = slot & ~same
    role = F.when(F.col("z.t") == P_NUMBER, F.col("z.next"))
    out = tok.groupBy("text_key", "item_id", "n", "lay").agg(
        F.sum("z.w").alias("matched_tokens"), F.size(F.collect_set(F.when(exchanged, F.struct("z.t", "z.b", role)))).alias("values"),
        F.size(F.collect_set(F.when(exchanged, F.struct("z.t", "z.b", role, "z.d")))).alias("pairs"),
        F.count(F.when(slot, 1)).alias("n_slots"), F.bool_and(same).alias("verbatim"), F.count(F.when(~slot, 1)).alias("literal"),
        F.max("opening").alias("opening"), F.collect_set(F.when(F.col("z.t") == P_NAME, F.struct("z.b", "z.d"))).alias("met"))
    strange = F.filter("met", lambda x: (x["b"] == F.col("opening.name")) & ~F.endswith(F.col("opening.words"), F.concat(F.lit(" "), x["d"])))
    out = out.where(F.size(strange) == 0)
    m = F.col("matched_tokens")
    out = out.where((F.col("values") == F.col("pairs")) & ((m >= min_tokens) | (m >= min_share * F.col("n")))
                    & (F.col("literal") >= MIN_WORDS) & (2 * F.col("literal") >= m))
    best = F.max(F.struct("matched_tokens", "verbatim", "n_slots")).alias("b")
    return out.groupBy("text_key", "item_id", F.col("n").alias("item_tokens")).agg(best).select(
        "text_key", "item_id", "b.matched_tokens", "item_tokens", "b.n_slots", "b.verbatim")


# ------------------------------------------------------------------ matching
def longest_run(places: Column) -> Column:
    """Length of the longest run of consecutive numbers in a sorted array."""
    zero = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, p: Column) -> Column:
        run = F.when(p == a["last"] + 1, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(p.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))
    return F.aggregate(places, zero, step, lambda a: a["best"])


def benchmark_windows(bench: DataFrame, width: int, item: str, text: str) -> DataFrame:
    """(item_id, n, w, ipos, h, btokens, bsurf): the windows searched for."""
    b = bench.select(pick(bench, item, "long").alias("item_id"), surfaces(pick(bench, text, "string")).alias("s"))
    b = b.where(F.size("s") >= MIN_WIDTH).withColumn("t", F.transform("s", token_of))
    b = b.withColumn("n", F.size("t")).withColumn("w", F.least(F.col("n"), F.lit(width)))
    b = b.select("item_id", "n", "w", "s", "t", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("w") + 1)).alias("ipos"))
    b = b.select("item_id", "n", "w", "ipos", F.slice("t", F.col("ipos"), F.col("w")).alias("btokens"),
                 F.slice("s", F.col("ipos"), F.col("w")).alias("bsurf"))
    literal = F.size(F.filter("btokens", lambda x: ~x.startswith("\x01")))
    return b.where(literal >= MIN_WORDS).withColumn("h", F.xxhash64("btokens"))


def matches(docs: DataFrame, bench: DataFrame, width: int = 8, min_tokens: int = 13, min_share: float = 0.6,
            text: str = "text", item: str = "item_id", item_text: str = "text", fold_case: bool = False) -> DataFrame:
    """(text_key, item_id, matched_tokens, item_tokens, n_slots, verbatim): a row
    per distinct text and benchmark item that it holds."""
    bw, n = counted(benchmark_windows(bench, width, item, item_text))
    widths = sorted(r["w"] for r in bw.select("w").distinct().collect())  # at most ``width`` numbers
    pw, n_plain = counted(plain_windows(bench, width, item, item_text, fold_case))
    plain_widths = sorted(r["w"] for r in pw.select("w").distinct().collect())
    tiles, grams = loose_tiles(bench, item, item_text) if fold_case else (None, None)
    t = pick(docs, text, "string")
    d = docs.select(t.alias("text")).where("text is not null").withColumn("text_key", F.xxhash64("text"))

    # texts with a gram of a window, then texts with a hit
    wanted = first_grams(bw, pw, min_tokens, min_share)
    if fold_case:
        wanted = wanted.union(best_grams(grams.select(F.concat_ws(" ", "gram").alias("text"))).select("h", "k"))
    d = materialise(texts_with_grams(d, wanted.distinct()).dropDuplicates(["text_key"]))
    loose = loose_matches(d, tiles, grams, min_tokens, min_share) if fold_case else None
    hashes = hint_small(bw.select("h").union(pw.select("h")).distinct(), n + n_plain, 16)
    split = F.split(template(F.col("text")), " ")
    plain = plain_tokens(F.col("text"), fold_case)
    found = [window_hashes(split, w) for w in widths] + [window_hashes(plain, w) for w in plain_widths]
    if not found:
        found = [F.array().cast("array<bigint>")]
    one = found[0] if len(found) == 1 else F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull()))
    hit = (d.select("text_key", F.explode(one).alias("h")).join(hashes, "h", "left_semi").select("text_key").distinct())
    hit, n_hit = counted(hit)

    # align them: every window hit gives its tokens' places
    c = d.join(hint_small(hit, n_hit, 16), "text_key", "left_semi")
    plain = c.select("text_key", plain.alias("p"))
    c = c.select("text_key", surfaces(F.col("text")).alias("s"))
    c = c.withColumn("t", F.transform("s", token_of))

    def enough(k: Column) -> Column:
        return (k >= min_tokens) | (k >= min_share * F.col("n"))

    exact = plain_matches(plain, pw, n_plain, plain_widths, enough) if plain_widths else None
    at = None
    for w in widths:
        x = c.where(F.size("t") >= w).select("text_key", "s", "t", F.explode(F.sequence(F.lit(1), F.size("t") - (w - 1))).alias("pos"))
        x = x.select("text_key", "pos", F.slice("t", F.col("pos"), w).alias("dtokens"), F.slice("s", F.col("pos"), w).alias("dsurf"))
        x = x.withColumn("h", F.xxhash64("dtokens"))
        at = x if at is None else at.unionByName(x)
    others = [x for x in (exact, loose) if x is not None]
    if at is None:
        none = c.sparkSession.createDataFrame([], "text_key long, item_id long, matched_tokens long, item_tokens int, n_slots long, verbatim boolean")
        return _first_of([none, *others])
    j = at.join(hint_small(bw, n, 64 * width), "h").where("dtokens = btokens")
    tok = j.select("text_key", "item_id", "n", (F.col("pos") - F.col("ipos")).alias("diag"), "ipos",
                   F.posexplode(F.arrays_zip("btokens", "bsurf", "dsurf", F.slice(
                       F.concat("btokens", F.array(F.lit(""))), 2, F.size("btokens")).alias("next"))).alias("i", "z"))
    # a window's last token has no next one there; another window of the place has it
    tok = (tok.groupBy("text_key", "item_id", "n", "diag", (F.col("ipos") + F.col("i")).alias("place"))
           .agg(F.max(F.struct("z.next", "z.btokens", "z.bsurf", "z.dsurf")).alias("z")))
    slot, same = F.col("z.btokens").startswith("\x01"), F.col("z.bsurf") == F.col("z.dsurf")
    exchanged = slot & ~same
    role = F.when(F.col("z.btokens") != P_NAME, F.col("z.next"))
    left, pair = F.struct("z.btokens", "z.bsurf", role), F.struct("z.btokens", "z.bsurf", role, "z.dsurf")
    out = tok.groupBy("text_key", "item_id", "n", "diag").agg(
        F.count(F.lit(1)).alias("matched_tokens"), F.size(F.collect_set(F.when(exchanged, left))).alias("values"),
        F.size(F.collect_set(F.when(exchanged, pair))).alias("pairs"), F.count(F.when(slot, 1)).alias("n_slots"),
        F.bool_and(same).alias("verbatim"), longest_run(F.sort_array(F.collect_list(F.when(same, F.col("place"))))).alias("run"))
    out = out.where(((F.col("values") == F.col("pairs")) & enough(F.col("matched_tokens"))) | enough(F.col("run")))
    # the longest alignment of a text and an item
    best = F.max(F.struct("matched_tokens", "verbatim", "n_slots")).alias("b")
    out = materialise(out.groupBy("text_key", "item_id", F.col("n").alias("item_tokens")).agg(best).select(
        "text_key", "item_id", "b.matched_tokens", "item_tokens", "b.n_slots", "b.verbatim"))
    return _first_of([out, *others])


def _first_of(paths: list[DataFrame]) -> DataFrame:
    """The rows of the first path, and those of each further one for texts and
    items that no earlier path has."""
    out = paths[0]
    for more in paths[1:]:
        have, n = counted(out.select(F.col("text_key").alias("k"), F.col("item_id").alias("i")))
        have = hint_small(have, n, 16)
        out = out.unionByName(more.join(have, (F.col("text_key") == F.col("k")) & F.col("item_id").eqNullSafe(F.col("i")), "left_anti"))
    return out


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """(row, text_key): the columns of ``docs`` in a struct, so that no name of
    theirs meets one of ours; the key is null for a null text."""
    t = pick(docs, text, "string")
    return docs.select(F.struct("*").alias("row"), F.when(t.isNotNull(), F.xxhash64(t)).alias("text_key"))


def contaminated(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """A row per document and benchmark item that it holds."""
    m, n = counted(matches(docs, bench, text=text, **kw))
    t = pick(docs, text, "string")
    d = docs.select(pick(docs, key, "long").alias("id"), F.when(t.isNotNull(), F.xxhash64(t)).alias("text_key"))
    return d.join(hint_small(m, n, 64), "text_key").select(
        F.col("id").alias(key), "item_id", "matched_tokens", "item_tokens", "n_slots", "verbatim")


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", **kw) -> DataFrame:
    """``docs`` without the texts that hold a benchmark item."""
    m, n = counted(matches(docs, bench, text=text, **kw).select("text_key").distinct())
    return _keyed(docs, text).join(hint_small(m, n, 16), "text_key", "left_anti").select("row.*")
