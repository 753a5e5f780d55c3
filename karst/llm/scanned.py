"""Problem 4: text of scanned pages, repaired into continuous paragraphs.

Words are grouped by their glyph skeleton: letters and the signs mistaken for them are
reduced to strokes (c, e, o, a, 0, @ are one bow; i, l, t, 1 one stem; m three stems, as
are rn and in; d bow and stem, as is cl), so a misread word and the right one fall
together. In a group the frequent form that the neighbouring words support is the right
one. Running lines are found at the edges of pages by their skeleton with digits masked.
Reflow joins what windows over pages and elements say is the next line of text.

Windows run over the edge lines of a page and over one summary row of each item in a block
of pages, blocks being tied by a row each, so a document of any length is spread. Word and
bigram counts cover all items and are joined, not collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.core.session import staged

from .sieve import sieve

#: Signs that scanning confuses, as strokes. A string stands for its characters.
_ACCENTS = ("àáâãäåèéêëìíîïòóôõöùúûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy")
_BOWS = "ceoa0@("
_STEMS = "ilt1|!fr"
_OTHERS = ("y5$296", "vsszgb")
_WIDE = {"m": "iii", "n": "ii", "u": "ii", "h": "ii", "d": "oi", "w": "vv"}
_LIGATURES = {"ﬁ": "fi", "ﬂ": "fl"}
_HYPHENS = "-‐¬­"
_STRIP = r"""^[\s.,;:!?"'“”‘’«»()\[\]{}*•_…]+|[\s.,;:!?"'“”‘’«»()\[\]{}*•_…]+$"""
_MARKS = " \t\n\x0b\x0c\r.,;:!?\"'“”‘’«»()[]{}*•_…"  # the same signs, for trimming
_NUMBER = (
    r"(?i)^[\s\-–—\[\](){}|.·*]*(?:(?:p|pp|pg|pag|page|pagina|página|pág)\b[.:]?\s*)?"
    r"([0-9oOlI]{1,4})\s*(?:(?:/|di|of|de)\s*[0-9oOlI]{1,4})?[\s\-–—\[\](){}|*]*$"
)


@dataclass(frozen=True)
class Params:
    edge: int = 3  # non-blank lines from the top and the bottom of a page that may be running
    frequent: int = 5  # least occurrences of a right form
    ratio: float = 8.0  # how much more frequent it must be than the misread form
    edge_share: float = 0.8  # of a running line's occurrences, those at edges
    block: int = 64  # pages of a document that one window takes


def skeleton(word: Column) -> Column:
    """Strokes of a word: equal for a word and its likely misreadings."""
    s = F.translate(F.lower(word), *_ACCENTS)
    for glyph, letters in _LIGATURES.items():
        s = F.replace(s, F.lit(glyph), F.lit(letters))
    s = F.translate(s, _BOWS + _STEMS + _OTHERS[0], "o" * len(_BOWS) + "i" * len(_STEMS) + _OTHERS[1])
    for letter, strokes in _WIDE.items():
        s = F.replace(s, F.lit(letter), F.lit(strokes))
    return s


def items(page_bodies: DataFrame, text_elements: DataFrame) -> DataFrame:
    """item_id, doc, page, seq, etype, text: both tables, each key once, null texts left out."""
    a = page_bodies.select(
        F.col("body_id").alias("item_id"), F.concat(F.lit("b/"), "doc_id").alias("doc"), F.col("page_no").alias("page"),
        F.lit(0).alias("seq"), F.lit(None).cast("string").alias("etype"), F.col("body").alias("text"),
    )
    b = text_elements.select(
        F.col("element_id").alias("item_id"), F.concat(F.lit("t/"), "doc_id").alias("doc"), "page", "seq",
        F.lower("element_type").alias("etype"), "text",
    )
    both = a.unionByName(b).where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    # an item without document or page is a document or page of its own
    both = both.withColumns({"doc": F.coalesce("doc", F.concat(F.lit("i/"), "item_id")), "page": F.coalesce("page", F.lit(-1)), "seq": F.coalesce("seq", F.lit(0))})
    return both.dropDuplicates(["item_id"])


_BLANK = r"^[\s\u00a0]*$"


def key_of(line: Column) -> Column:
    """Skeleton of a line without its numbers; of a long one the beginning and the hash of the whole."""
    numbers = F.regexp_replace(line, r"(?<![\p{L}])[0-9oOlI|]*[0-9][0-9oOlI|./\-]*(?![\p{L}])", " ")
    plain = F.when(line.rlike("[0-9]"), numbers).otherwise(line)  # few lines have a digit
    key = F.regexp_replace(skeleton(F.regexp_replace(plain, r"[^\p{L}0-9@(|!$]+", " ")), r"[ (|]+", " ")
    key = F.trim(key)
    return F.when(F.length(key) > 200, F.concat(F.substring(key, 1, 200), F.xxhash64(key).cast("string"))).otherwise(key)


def numbered_lines(text: Column) -> Column:
    """(line_no, line) of the non-blank lines."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    return F.filter(lines, lambda x: ~x.line.rlike(_BLANK))


def edge_lines(rows: DataFrame, p: Params) -> DataFrame:
    """The first and last lines of every page with their rank from the top and the bottom.

    Only the first and last few lines of an item can be a page's, so no other line moves.
    """
    rows = rows.withColumn("lines", numbered_lines(F.col("text"))).withColumn("n", F.size("lines"))
    few = F.filter("lines", lambda x, i: (i < p.edge) | (i >= F.col("n") - p.edge))
    lines = rows.select("item_id", "doc", "page", "seq", "etype", F.inline(few))
    page = Window.partitionBy("doc", "page")
    order = ["seq", "item_id", "line_no"]
    lines = lines.withColumns({
        "top": F.row_number().over(page.orderBy(*order)),
        "bottom": F.row_number().over(page.orderBy(*(F.desc(c) for c in order))),
    }).where((F.col("top") <= p.edge) | (F.col("bottom") <= p.edge))
    number = F.translate(F.regexp_extract("line", _NUMBER, 1), "oOlI", "0011")
    return lines.withColumns({"number": F.when(number != "", number.try_cast("int")), "key": key_of(F.col("line"))})


def furniture(rows: DataFrame, p: Params) -> DataFrame:
    """item_id, line_no, role (running or page_number) of the lines that are no text."""
    lines = staged(edge_lines(rows, p))
    # page numbers follow the page of the table, or differ from it alike throughout the document
    offsets = lines.where("number is not null").select("doc", "page", (F.col("number") - F.col("page")).alias("offset")).distinct()
    common = offsets.groupBy("doc", "offset").agg(F.count("*").alias("pages")).where("pages >= 2").select("doc", "offset", F.lit(True).alias("steady"))
    lines = lines.withColumn("offset", F.col("number") - F.col("page")).join(common, ["doc", "offset"], "left")
    decorated = F.length(F.regexp_replace("line", r"[0-9\s]", "")) > 0
    outer = (F.col("top") <= 2) | (F.col("bottom") <= 2)
    lines = staged(lines.withColumn("numbered", F.col("number").isNotNull() & (F.coalesce("steady", F.lit(False)) | F.col("offset").between(0, 1) | (decorated & outer))))
    usable = lines.where((F.length("key") >= 4) & ~F.col("numbered")).withColumn("h", F.xxhash64("key"))
    everywhere = rows.select(F.explode(F.transform(numbered_lines(F.col("text")), lambda x: F.xxhash64(key_of(x.line)))).alias("h")).groupBy("h").agg(F.count("*").alias("everywhere"))
    in_doc = usable.groupBy("h", "doc", "page").agg(F.count("*").alias("n")).groupBy("h", "doc").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))
    at_edges = in_doc.groupBy("h").agg(F.sum("n").alias("at_edge"), F.count("*").alias("docs"))
    by_key = at_edges.join(everywhere, "h", "left").where(F.col("at_edge") >= p.edge_share * F.coalesce("everywhere", "at_edge"))
    found = usable.join(by_key, "h").join(in_doc.select("h", "doc", "pages"), ["h", "doc"])
    typed = F.coalesce(F.col("etype").isin("page_header", "page_footer"), F.lit(False))
    running = (F.col("pages") >= 2) | ((F.col("docs") >= 3) & outer) | (typed & outer & (F.col("docs") >= 2))
    found = found.where(running).select("item_id", "line_no", F.lit("running").alias("role"))
    return found.unionByName(lines.where("numbered").select("item_id", "line_no", F.lit("page_number").alias("role")))


def raw_words(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"[\s ]+", " ")), " ")


def words_of(line: Column) -> Column:
    """(pos, word): lower-cased words of a line without surrounding punctuation and their place
    among what blanks part; bars of table rows and bare punctuation are none."""
    every = F.transform(raw_words(line), lambda w, i: F.struct(i.alias("pos"), F.lower(F.btrim(w, F.lit(_MARKS))).alias("word")))
    return F.filter(every, lambda x: (x.word != "") & (x.word != "|"))


def _block(p: Params) -> Column:
    return F.floor(F.col("page") / p.block).alias("blk")


def after_items(heads: DataFrame, p: Params) -> DataFrame:
    """item_id, after: the next row's `head` of the same document. `heads`: item_id, doc, page, seq, head.

    Windows take a block of pages; a block's last row gets the head of the next block that has any.
    """
    heads = heads.withColumn("blk", _block(p))
    order = F.struct("page", "seq", "item_id")
    inside = heads.withColumn("after", F.lead("head").over(Window.partitionBy("doc", "blk").orderBy("page", "seq", "item_id")))
    blocks = heads.groupBy("doc", "blk").agg(F.min_by("head", order).alias("head"))
    blocks = blocks.select("doc", "blk", F.lead("head").over(Window.partitionBy("doc").orderBy("blk")).alias("next_block"))
    return inside.join(blocks, ["doc", "blk"]).select("item_id", F.coalesce("after", "next_block").alias("after"))


def before_items(rows: DataFrame, p: Params) -> DataFrame:
    """item_id, base: the sum of `n` over the items of the same document before it, by blocks as above."""
    rows = rows.withColumn("blk", _block(p))
    to_here = Window.unboundedPreceding, -1
    inside = rows.withColumn("own", F.sum("n").over(Window.partitionBy("doc", "blk").orderBy("page", "seq", "item_id").rowsBetween(*to_here)))
    blocks = rows.groupBy("doc", "blk").agg(F.sum("n").alias("n"))
    blocks = blocks.select("doc", "blk", F.sum("n").over(Window.partitionBy("doc").orderBy("blk").rowsBetween(*to_here)).alias("earlier"))
    zero = F.lit(0)
    return inside.join(blocks, ["doc", "blk"]).select("item_id", (F.coalesce("own", zero) + F.coalesce("earlier", zero)).alias("base"))


def text_lines(rows: DataFrame, roles: DataFrame, p: Params) -> DataFrame:
    """The lines of text of every item, each with `nxt` (item_id, line_no, line): the next line of
    text with a word in the document, perhaps on another page or element; null after the last and
    for lines without words."""
    # few lines an item: its furniture fits one row
    out = roles.groupBy("item_id").agg(F.collect_set("line_no").alias("out"))
    kept = rows.select("item_id", "doc", "page", "seq", "text").join(out, "item_id", "left").withColumn("out", F.coalesce("out", F.array().cast("array<int>")))
    kept = kept.select("item_id", "doc", "page", "seq", F.filter(numbered_lines(F.col("text")), lambda x: ~F.array_contains("out", x.line_no)).alias("lines")).where(F.size("lines") > 0)
    wordy = lambda x: x.line.rlike(r"[\p{L}\p{N}]")
    kept = kept.withColumns({"wordy": F.filter("lines", wordy), "bare": F.filter("lines", lambda x: ~wordy(x))})
    as_next = lambda x, item: F.struct(item.alias("item_id"), x.line_no.alias("line_no"), x.line.alias("line"))
    heads = kept.where(F.size("wordy") > 0).select("item_id", "doc", "page", "seq", as_next(F.col("wordy")[0], F.col("item_id")).alias("head"))
    kept = kept.join(after_items(heads, p), "item_id", "left")
    with_next = F.transform("wordy", lambda x, i: F.struct(
        x.line_no.alias("line_no"), x.line.alias("line"),
        F.when(i + 1 < F.size("wordy"), as_next(F.get(F.col("wordy"), i + 1), F.col("item_id"))).otherwise(F.col("after")).alias("nxt"),
    ))
    none = F.lit(None).cast("struct<item_id:string,line_no:int,line:string>")
    without = F.transform("bare", lambda x: F.struct(x.line_no.alias("line_no"), x.line.alias("line"), none.alias("nxt")))
    return kept.select("item_id", "doc", "page", "seq", F.inline(F.concat(with_next, without)))


class Repaired(NamedTuple):
    """spots: item_id, line_no, kind, word, distinct. lines: every line of text with its words and
    what follows. fixes: item_id, line_no, pos, word. joins: item_id, line_no, word, nxt of the
    words broken at a line's end."""

    spots: DataFrame
    lines: DataFrame
    fixes: DataFrame
    joins: DataFrame


def repair(page_bodies: DataFrame, text_elements: DataFrame, p: Params = Params()) -> Repaired:
    """The spots to repair and what `paragraphs` needs to repair them.

    Null and blank texts give nothing; repeated rows of a key count once. Lines of bare
    punctuation or bars hold no word: a broken word goes on behind them.
    """
    rows = staged(items(page_bodies, text_elements))
    roles = staged(furniture(rows, p))
    marked = roles.select("item_id", "line_no", F.col("role").alias("kind"), F.lit("").alias("word"))
    text = text_lines(rows, roles, p)
    last = F.element_at(F.split(F.regexp_replace("line", r"[\s ]+$", ""), r"[\s ]"), -1)
    broken = last.rlike(rf"\p{{L}}[{_HYPHENS}]$") & F.trim("nxt.line").rlike(r"^\p{L}") & ~F.trim("line").startswith("|")
    stem = F.lower(F.regexp_replace(F.regexp_replace(last, rf"[{_HYPHENS}]$", ""), _STRIP, ""))
    text = text.withColumns({"words": words_of(F.col("line")), "stem": F.when(broken, stem), "head": F.when(broken, F.get(words_of(F.col("nxt.line")), 0)["word"])})
    text = staged(text.withColumn("stem", F.when(F.col("head").isNotNull(), F.col("stem"))))

    # counts over all lines; the halves of broken words are no words
    beside = F.transform("words", lambda w, i: F.struct(
        w.pos.alias("pos"), w.word.alias("word"), F.when(i > 0, F.get("words", i - 1)["word"]).alias("before"), F.get("words", i + 1)["word"].alias("after"),
        (F.col("stem").isNotNull() & (i == F.size("words") - 1)).alias("half"),
    ))
    tokens = text.select("item_id", "line_no", F.inline(beside))
    whole = tokens.where(~F.col("half") & F.col("word").rlike(r"\p{L}"))
    lexicon = staged(whole.groupBy("word").agg(F.count("*").alias("n")).withColumn("sk", skeleton(F.col("word"))))

    halves = text.where("stem is not null").select("item_id", "line_no", "nxt", F.concat("stem", "head").alias("plain"), F.concat_ws("-", "stem", "head").alias("dashed"))
    known = lexicon.select("word", "n")
    halves = halves.join(known.select(F.col("word").alias("plain"), F.col("n").alias("n_plain")), "plain", "left")
    halves = halves.join(known.select(F.col("word").alias("dashed"), F.col("n").alias("n_dashed")), "dashed", "left")
    halves = halves.withColumn("word", F.when(F.coalesce("n_dashed", F.lit(0)) > F.coalesce("n_plain", F.lit(0)), F.col("dashed")).otherwise(F.col("plain")))
    best = lexicon.where(F.col("n") >= p.frequent).groupBy("sk").agg(F.max_by("word", F.struct("n", "word")).alias("right"))
    halves = halves.withColumn("sk", skeleton(F.col("word"))).join(best, "sk", "left")
    unknown = F.coalesce("n_plain", F.lit(0)) + F.coalesce("n_dashed", F.lit(0)) == 0
    joins = staged(halves.select("item_id", "line_no", F.when(unknown & F.col("right").isNotNull(), F.col("right")).otherwise(F.col("word")).alias("word"), "nxt"))

    fixes = staged(misreadings(tokens, lexicon, p))
    spots = marked.unionByName(joins.select("item_id", "line_no", F.lit("hyphen").alias("kind"), "word"))
    spots = spots.unionByName(fixes.select("item_id", "line_no", F.lit("misread").alias("kind"), "word"))
    return Repaired(spots.distinct(), text, fixes, joins)


def misreadings(tokens: DataFrame, lexicon: DataFrame, p: Params) -> DataFrame:
    """item_id, line_no, pos, word: the right form of each word that a frequent form of its skeleton replaces."""
    right = lexicon.where(F.col("n") >= p.frequent).where(~F.col("word").rlike(r"[0-9@|(!$]")).select("sk", F.col("word").alias("right"), F.col("n").alias("n_right"))
    odd = F.col("word").rlike(r"[0-9@|(!$ﬁﬂü]")
    pairs = lexicon.join(right, "sk").where((F.col("word") != F.col("right")) & (F.col("n_right") >= p.ratio * F.col("n")))
    pairs = staged(pairs.select("word", "right", "n_right", odd.alias("odd")).where(F.col("odd") | (F.length("word") >= 3)))

    places = sieve(tokens.where(~F.col("half")), "word", pairs).join(pairs, "word")
    # bigrams that would support a form at its place, and those of the word as it stands there
    ask = lambda first, second, own: F.struct(F.xxhash64(first, second).alias("h"), (F.col(first).isNotNull() & F.col(second).isNotNull()).alias("there"), F.lit(own).alias("own"))
    asked = F.array(ask("before", "right", False), ask("right", "after", False), ask("before", "word", True), ask("word", "after", True))
    place = ["item_id", "line_no", "pos", "right", "n_right", "odd"]
    needs = places.select(*place, F.inline(asked))
    # every bigram counts, by its hash: summed before the shuffle, two numbers a bigram
    bigrams = tokens.where("before is not null").groupBy(F.xxhash64("before", "word").alias("h")).agg(F.count("*").alias("b"))
    needs = needs.join(bigrams, "h", "left")
    n = F.when(F.col("there"), F.coalesce("b", F.lit(0))).otherwise(0)
    sums = needs.groupBy(*place).agg(
        F.sum(F.when(~F.col("own"), n).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("own"), F.greatest(n - 1, F.lit(0))).otherwise(0)).alias("elsewhere"),  # the place itself is no support
    )
    supported = (F.col("support") > p.ratio * F.col("elsewhere")) & (F.col("odd") | (F.col("support") >= 2))
    sums = sums.where(supported | (F.col("odd") & (F.col("elsewhere") == 0)))
    return sums.groupBy("item_id", "line_no", "pos").agg(F.max_by("right", F.struct("support", "n_right", "right")).alias("word"))


_LEAD, _TRAIL = _STRIP.split("|", 1)[0], r"""[\s.,;:!?"'“”‘’«»()\[\]{}*•_…]+$"""
_SENTENCE_END = r"""[.!?…:;]["'”’»)\]]*\s*$"""


def _dressed(word: Column, first: Column, last: Column) -> Column:
    """`word` with the case of `first`'s first letter, its leading marks, and the trailing marks of `last`."""
    capital = F.regexp_extract(first, r"\p{L}", 0).rlike(r"^\p{Lu}$")
    cased = F.when(capital, F.concat(F.upper(F.substring(word, 1, 1)), word.substr(F.lit(2), F.length(word)))).otherwise(word)
    return F.concat(F.regexp_extract(first, _LEAD, 0), cased, F.regexp_extract(last, _TRAIL, 0))


def paragraphs(found: Repaired, p: Params = Params()) -> DataFrame:
    """doc, paragraph_no, item_id (where it begins), paragraph: the text of each document reflowed,
    without running lines and page numbers; broken words stand whole on the line where they begin,
    misread ones are replaced at their place, with the marks and the capital they had.

    A paragraph ends at a blank line, and at an item's end unless its last line ends no sentence
    and the next line goes on in lower case, or a word is broken there.
    """
    key = ["item_id", "line_no"]
    fix = found.fixes.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "word"))).alias("fix"))  # one word a place
    begun = found.joins.select(*key, F.col("word").alias("joined"))
    ended = found.joins.select(F.col("nxt.item_id").alias("item_id"), F.col("nxt.line_no").alias("line_no"), F.lit(True).alias("carried"))
    marks = fix.join(begun, key, "full").join(ended, key, "full")  # few lines have any

    # what moves with a line is its text and what its neighbours say of it, not its words
    first, last = F.get("words", 0)["pos"], F.get("words", F.size("words") - 1)["pos"]
    tail = F.when(F.col("stem").isNotNull(), F.get(raw_words(F.col("nxt.line")), F.get(words_of(F.col("nxt.line")), 0)["pos"]))
    open_end = ~F.col("line").rlike(_SENTENCE_END) & F.trim("nxt.line").rlike(r"^\p{Ll}")
    lines = found.lines.select("item_id", "doc", "page", "seq", "line_no", "line", first.alias("first"), last.alias("last"), tail.alias("tail"), F.col("nxt.item_id").alias("next_item"), open_end.alias("open_end"))
    beyond = F.col("next_item").isNotNull() & (F.col("next_item") != F.col("item_id"))
    # items whose last line goes on in another item: by its end, or by a broken word
    ends = lines.where(beyond).join(begun.select(*key, F.lit(True).alias("broken")), key, "left")
    continued = ends.where(F.col("open_end") | F.col("broken")).select(F.col("next_item").alias("item_id"), F.lit(True).alias("continued"))

    rows = lines.join(marks, key, "left").withColumn("carried", F.coalesce("carried", F.lit(False)))
    raw = raw_words(F.col("line"))
    fixed = F.transform(raw, lambda w, i: F.coalesce(_dressed(F.try_element_at("fix", i), w, w), w))
    whole = _dressed(F.col("joined"), F.get(raw, F.col("last")), F.col("tail"))
    body = F.transform(F.when(F.col("fix").isNull(), raw).otherwise(fixed), lambda w, i: F.when(F.col("joined").isNotNull() & (i == F.col("last")), whole).when(F.col("carried") & (i == F.col("first")), "").otherwise(w))
    plain = F.col("fix").isNull() & F.col("joined").isNull() & ~F.col("carried")  # most lines are as they were
    flow = F.when(plain, F.array_join(raw, " ")).otherwise(F.array_join(F.filter(body, lambda w: w != ""), " "))
    rows = rows.select("item_id", "doc", "page", "seq", "line_no", flow.alias("flow")).join(continued, "item_id", "left")
    w = Window.partitionBy("item_id").orderBy("line_no")
    new = F.coalesce(F.col("line_no") - F.lag("line_no").over(w) > 1, F.col("continued").isNull())
    rows = staged(rows.withColumn("new", new.cast("int")).withColumn("nth", F.sum("new").over(w)))
    base = before_items(rows.groupBy("item_id", "doc", "page", "seq").agg(F.sum("new").alias("n")), p)
    rows = rows.join(base, "item_id").withColumn("paragraph_no", F.col("base") + F.col("nth") - 1)
    parts = F.array_sort(F.collect_list(F.struct("page", "seq", "item_id", "line_no", "flow")))  # the lines of one paragraph
    out = rows.groupBy("doc", "paragraph_no").agg(parts.alias("parts"))
    flow = F.array_join(F.filter(F.transform("parts", lambda x: x.flow), lambda x: x != ""), " ")
    return out.select("doc", "paragraph_no", F.col("parts")[0]["item_id"].alias("item_id"), flow.alias("paragraph"))
