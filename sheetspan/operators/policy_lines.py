"""Places of guidelines on the pages of the policy document that they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import stage

C = F.col
#: White space and quotes that comparisons leave out; the least length of a text that may be held in another one, and what is added
#: where the line or the excerpt is held; the length over which a word counts, how many words are needed and the least share of them that a line
#: holds; the least score beside the best one and the most lines; up to where a rectangle is in fractions of its page.
SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
QUOTES = "[“”\"']"
HELD_LENGTH, LINE_HELD, EXCERPT_HELD = 16, 0.4, 0.35
SHORT_WORD, LEAST_WORDS, LEAST_SHARE = 3, 3, 0.55
NEAR_BEST, MOST_LINES = 0.7, 4
FRACTION = 1.5
#: Characters of a word by which words are looked up among the tokens that may hold them.
GRAM = SHORT_WORD + 1


def plain(text: Column) -> Column:
    """Lower case, single blanks, no quotes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), SPACE, " "), QUOTES, ""))


def line_score(line: str, excerpt: str, words: list[str]) -> float:
    """How well a line fits an excerpt with these words, both plain: by what share of the longer one is held, else by the share of the words in it; 0 if it does not."""
    if len(line) >= HELD_LENGTH and line in excerpt:
        return len(line) / len(excerpt) + LINE_HELD
    if len(excerpt) >= HELD_LENGTH and excerpt in line:
        return len(excerpt) / len(line) + EXCERPT_HELD
    share = sum(w in line for w in words) / len(words) if len(words) >= LEAST_WORDS else 0.0
    return share if share >= LEAST_SHARE else 0.0


def _words(text: str) -> list[str]:
    return [w for w in text.split(" ") if len(w) > SHORT_WORD]


class _Lines:
    """The plain lines of one document, found by their words, by their beginnings and by given stretches of characters."""

    def __init__(self, texts: list[str], stretches: set[str]):
        self.of_token, self.of_gram, self.of_beginning, self.of_stretch = {}, {}, {}, {}
        for i, text in enumerate(texts):
            for token in set(_words(text)):
                self.of_token.setdefault(token, []).append(i)
            if len(text) >= HELD_LENGTH:
                self.of_beginning.setdefault(text[:HELD_LENGTH], []).append(i)
            for k in range(len(text) - HELD_LENGTH + 1) if stretches else ():
                if text[k : k + HELD_LENGTH] in stretches:
                    self.of_stretch.setdefault(text[k : k + HELD_LENGTH], set()).add(i)
        for token in self.of_token:
            for gram in {token[k : k + GRAM] for k in range(len(token) - GRAM + 1)}:
                self.of_gram.setdefault(gram, []).append(token)
        self.of_word = {}

    def holders(self, word: str) -> tuple[int, list[str]]:
        """How many lines hold a word, and the tokens that do: a word is held in a line if it is held in one of its tokens, as it has no blank."""
        if word not in self.of_word:
            tokens = [t for t in self.of_gram.get(word[:GRAM], ()) if word in t]
            self.of_word[word] = sum(len(self.of_token[t]) for t in tokens), tokens
        return self.of_word[word]

    def near(self, excerpt: str, words: list[str]) -> set[int]:
        """Lines that may fit: those that hold one of the excerpt's rarest words, so many of these that a line without any of them holds too few; those whose
        beginning the excerpt holds; and those that hold the beginning of an excerpt without words."""
        found, left = set(), len(words)
        for word in sorted(set(words), key=lambda w: (self.holders(w)[0], w)):
            if left / len(words) < LEAST_SHARE:
                break
            found.update(i for t in self.holders(word)[1] for i in self.of_token[t])
            left -= words.count(word)
        for k in range(len(excerpt) - HELD_LENGTH + 1):
            found.update(self.of_beginning.get(excerpt[k : k + HELD_LENGTH], ()))
        return found if words else found | self.of_stretch.get(excerpt[:HELD_LENGTH], set())


def _best_of_document(excerpts, lines, schema):
    """The best lines of one document's excerpts, from and to Arrow tables."""
    import pyarrow as pa

    out = []
    if excerpts.num_rows and lines.num_rows:
        own, asked = lines.to_pylist(), excerpts.to_pylist()
        index = _Lines([x["a"] for x in own], {e["b"][:HELD_LENGTH] for e in asked if len(e["b"]) >= HELD_LENGTH and not _words(e["b"])})
        for e in asked:
            words = _words(e["b"])
            scored = ((line_score(own[i]["a"], e["b"], words), own[i]) for i in index.near(e["b"], words))
            best = sorted(((-score, x["ord"], x["page"]) for score, x in scored if score > 0), key=lambda x: x[:2])
            near = [(n, score) for score, n, page in best if page == best[0][2] and -score >= -best[0][0] * NEAR_BEST]
            out += [(e["doc_id"], e["guideline_id"], n, -score, k + 1) for k, (n, score) in enumerate(near[:MOST_LINES])]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(schema), schema, strict=True)], schema=schema)


def best_lines(guidelines: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of a document that fit an excerpt best: doc_id, guideline_id, ord, score, n (1 for the best).

    guidelines: doc_id, guideline_id, excerpt; lines: doc_id, ord, page, text.  Lines on the page of the best one count, of at least 0.7 of its score and
    at most four; of equals the earlier.  Lines and excerpts are shuffled once, by document, and a document's lines are indexed in its task: a line is scored
    only if it shares one of the excerpt's rarest words or 16 characters with it, so a document's lines and guidelines are never all paired.  Null and empty
    texts fit nothing; a null document has no lines.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, IntegerType, StructType

    excerpts = guidelines.select("doc_id", "guideline_id", plain(C("excerpt")).alias("b")).where("doc_id IS NOT NULL AND b <> ''")
    own = lines.select("doc_id", "ord", "page", plain(C("text")).alias("a")).where("doc_id IS NOT NULL AND ord IS NOT NULL AND a <> ''")
    found = StructType([*excerpts.schema.fields[:2], own.schema["ord"]]).add("score", DoubleType()).add("n", IntegerType())
    schema = to_arrow_schema(found)
    return excerpts.groupBy("doc_id").cogroup(own.groupBy("doc_id")).applyInArrow(lambda e, a: _best_of_document(e, a, schema), found)


def _unions(placed: DataFrame) -> DataFrame:
    """One rectangle a page around lines of a guideline, pages in the order of their first line; placed: the keys, n, page, line_id and the rectangle."""
    right, bottom = F.max(C("x") + C("width")), F.max(C("y") + C("height"))
    a_page = placed.groupBy("doc_id", "guideline_id", "page").agg(
        F.min("n").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), right.alias("right"), bottom.alias("bottom"), F.collect_list(F.struct("n", "line_id")).alias("ids")
    )
    rect = F.struct("page", "x", "y", (C("right") - C("x")).alias("width"), (C("bottom") - C("y")).alias("height"))
    out = a_page.groupBy("doc_id", "guideline_id").agg(F.array_sort(F.collect_list(F.struct("n", rect.alias("r")))).alias("r"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    return out.select("doc_id", "guideline_id", C("r.r").alias("found_rects"), C("ids.line_id").alias("found_ids"))


def guideline_lines(guidelines: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Where each guideline stands: doc_id, guideline_id, page, line_ids, rects, source.

    guidelines: doc_id, guideline_id (one row each), page, line_ids, source_text, text, rects; lines: doc_id, line_id, ord (in a document's order), page, x, y,
    width, height, text; pages: doc_id, page, width, height.  By the lines that a guideline names (``source`` ids; of lines that repeat an id the last counts),
    else by those that fit its source text, or text, best (text), else by its own rectangles, of which those in
    fractions become pixels of their page (rects), else null (none).  Rectangles are one a page around its lines.
    A page that a guideline has stays, else its first line's counts.
    """
    keys = ["doc_id", "guideline_id"]
    guidelines = stage(guidelines, "guidelines")
    at = ("page", "x", "y", "width", "height")
    named = guidelines.select(*keys, F.posexplode("line_ids").alias("n", "line_id"))
    last = lines.join(named.select("doc_id", "line_id").distinct(), ["doc_id", "line_id"], "left_semi").groupBy("doc_id", "line_id").agg(F.max_by(F.struct(*at), "ord").alias("at"))
    by_id = _unions(named.join(last, ["doc_id", "line_id"]).select(*keys, "n", "line_id", "at.*"))
    left = guidelines.join(by_id, keys, "left_anti").select(*keys, F.coalesce(F.when(C("source_text") != "", C("source_text")), C("text")).alias("excerpt"))
    by_text = _unions(best_lines(left, lines).join(lines.select("doc_id", "ord", "line_id", *at), ["doc_id", "ord"]))
    found = stage(by_id.withColumn("source", F.lit("ids")).unionByName(by_text.withColumn("source", F.lit("text"))), "found")
    stated = F.when(C("page") != 0, C("page"))
    own = guidelines.join(found, keys, "left_anti").select(*keys, stated.alias("stated"), F.posexplode("rects").alias("n", "r")).select(*keys, "n", F.coalesce(F.when(C("r.page") != 0, C("r.page")), "stated", F.lit(1)).alias("page"), "r")
    sizes = pages.groupBy("doc_id", "page").agg(F.max(F.struct("width", "height")).alias("size"))
    part = (C("r.width") <= FRACTION) & (C("r.height") <= FRACTION) & (C("r.x") <= FRACTION) & (C("r.y") <= FRACTION) & C("size").isNotNull()
    pixel = lambda c, side: (C("r")[c] * C("size")[side]).alias(c)
    scaled = F.struct("page", pixel("x", "width"), pixel("y", "height"), pixel("width", "width"), pixel("height", "height"))
    as_is = F.struct(C("r.page").alias("page"), *(C("r")[c].alias(c) for c in at[1:]))
    drawn = own.join(sizes, ["doc_id", "page"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", F.when(part, scaled).otherwise(as_is).alias("r")))).alias("r")).select(*keys, C("r.r").alias("drawn"))
    same = C("g.doc_id").eqNullSafe(C("d.doc_id")) & C("g.guideline_id").eqNullSafe(C("d.guideline_id"))
    rows = guidelines.join(found, keys, "left").alias("g").join(drawn.alias("d"), same, "left").select("g.*", "drawn")
    return rows.select(
        *keys, F.coalesce("page", F.get("found_rects", F.lit(0))["page"]).alias("page"), F.when(C("source") == "text", C("found_ids")).otherwise(C("line_ids")).alias("line_ids"),
        F.coalesce("found_rects", "drawn").alias("rects"), F.coalesce("source", F.when(C("drawn").isNotNull(), "rects"), F.lit("none")).alias("source"),
    )
