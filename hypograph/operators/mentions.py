"""Vocabulary terms found in sentences, with document, paragraph and sentence coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import merge_marks
from .sizing import dropped, keyed_join, small_side, written

COORDS = ["doc_pos", "para_pos", "sent_pos"]


def _words(sents: DataFrame, id_col: str, split) -> DataFrame:
    """Words numbered ``i`` in the sentence, and the tokens that ``split`` makes of the same words; white space is blanks."""
    spaced = F.when(F.col("text").rlike(tx.OTHER_BLANKS), tx.blanks_only(F.col("text"))).otherwise(F.col("text"))
    placed = sents.select(id_col, "para_pos", "sent_pos", "offset", spaced.alias("text"))
    split_up = placed.select("*", F.split("text", " ").alias("raw"), split(F.col("text")).alias("token"))
    return split_up.select(
        id_col, "para_pos", "sent_pos", "offset", "text", F.size("raw").alias("n"), F.posexplode(F.arrays_zip("raw", "token")).alias("i", "w")
    ).select(id_col, "para_pos", "sent_pos", "offset", "text", "n", "i", "w.*")


def _begins(text: Column, i: Column) -> Column:
    """Where word ``i`` of a text begins: behind its i-th blank. Asked for matches only, so most words need no sum."""
    return F.when(i > 0, F.length(F.call_function("substring_index", text, F.lit(" "), i)) + 1).otherwise(0)


def tokens(sents: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Cleaned tokens with their position number inside the sentence."""
    return sents.select(
        id_col, "para_pos", "sent_pos", F.posexplode(tx.token_split(F.col("text"))).alias("tok_pos", "token")
    ).filter(F.col("token") != "")


def _several(term: Column) -> Column:
    return tx.blanks_only(term).contains(" ")


def _matches(words: DataFrame, vocab: DataFrame, own: list[str], one_word: Column) -> DataFrame:
    """Words that begin a term, as rows of ``own`` columns with cat, term and ``start`` in the sentence.

    One rule for vocabularies of any size. A one-word term equals the token (where ``one_word`` allows it). A
    several-word term is met at a word with the same first word, punctuation in front of it left out on both
    sides, and is then compared with the text from there, any white space counting as a blank. A term without
    a letter or digit is never met.

    With a vocabulary measured as small the text stays in its row. Otherwise a word takes along as much text
    as the longest term needs, and the words are spread over salts, since most of them match nothing.
    """
    terms = vocab.select("cat", "term", tx.blanks_only(F.col("term")).alias("wanted"))
    terms = terms.withColumn("several", _several(F.col("term")))
    terms = terms.withColumn("probe", F.when(F.col("several"), tx.lead_key(F.col("term"))).otherwise(F.col("term")))
    terms = terms.withColumn("lead", F.when(F.col("several"), tx.lead_width(F.col("term"))).otherwise(0)).filter("probe != ''")
    has_one, has_several, longest, lead = terms.agg(
        F.bool_or(~F.col("several")), F.bool_or("several"), F.max(F.length("term")), F.max("lead")
    ).first()
    keys = [F.struct(F.col("token").alias("probe"), F.lit(False).alias("several"))] if has_one else []
    keys += [F.struct(tx.lead_key(F.col("raw")).alias("probe"), F.lit(True).alias("several"))] if has_several else []
    probes = words.withColumn("usable", one_word)
    if keys:
        probes = probes.withColumn("key", F.explode(F.array(*keys))).select("*", "key.*").drop("key")
    else:
        probes = probes.withColumns({"probe": F.lit(""), "several": F.lit(False)})
    probes = probes.filter((F.col("probe") != "") & (F.col("several") | F.col("usable")))
    # Where the word's first letter or digit stands, and the text from the longest lead before it on.
    at = _begins(F.col("text"), F.col("i"))
    letter = F.col("at") + tx.lead_width(F.col("raw"))
    begin = F.greatest(F.col("letter") - F.lit(lead or 0), F.lit(0))
    rest = F.col("text").substr(F.col("begin") + 1, F.lit((lead or 0) + (longest or 0)))
    side, is_small = small_side(terms)
    if is_small:
        met = probes.join(side, ["probe", "several"]).withColumn("at", at).withColumn("letter", letter)
        hits = met.withColumn("begin", begin).withColumn("rest", F.when(F.col("several"), rest))
    else:
        slim = probes.withColumn("at", at).withColumn("letter", letter).withColumn("begin", begin).withColumn("rest", F.when(F.col("several"), rest))
        hits = keyed_join(slim.select(*own, "at", "probe", "several", "letter", "begin", "rest"), terms, ["probe", "several"])
    start = F.col("letter") - F.col("lead")
    found = (start >= 0) & (F.col("rest").substr(start - F.col("begin") + 1, F.length("wanted")) == F.col("wanted"))
    hits = hits.filter(~F.col("several") | found)
    return hits.select(*own, "cat", "term", F.when(F.col("several"), start).otherwise(F.col("at")).alias("start"))


def mentions(sents: DataFrame, vocab: DataFrame, id_col: str = "article_id", strip_punct: bool = False) -> DataFrame:
    """All mentions of all categories, one-word and several-word terms, from one reading of the text.

    Every repeat and every overlapping occurrence is a mention at its own offset. One-word terms equal a token,
    several-word terms start at a word start (see ``_matches``).
    """
    def split(text):
        token = F.split(tx.without_marks(text), " ")
        return F.transform(token, tx.strip_punctuation) if strip_punct else token

    own = [id_col, "para_pos", "sent_pos", "offset"]
    hits = _matches(_words(sents, id_col, split), vocab, own, F.lit(True))
    return hits.select(
        id_col, "cat", F.col("term").alias("word"), (F.col("offset") + F.col("start")).alias("doc_pos"), "para_pos", "sent_pos"
    )


def single_word_mentions(
    sents: DataFrame, vocab: DataFrame, id_col: str = "article_id", strip_punct: bool = False
) -> DataFrame:
    """Tokens equal to a one-word term; every repeat is its own mention at its own offset."""
    return mentions(sents, vocab.filter(~_several(F.col("term"))), id_col, strip_punct)


def multi_word_mentions(sents: DataFrame, vocab: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Every occurrence (also overlapping) of a several-word term that starts at a word start."""
    return mentions(sents, vocab.filter(_several(F.col("term"))), id_col)


def padded_mentions(
    sents: DataFrame, vocab: DataFrame, id_col: str = "article_id", min_length: int = 3
) -> DataFrame:
    """First hit per sentence and term: one-word terms between white space, several-word terms at a word start.

    Dots count as blanks, so the position of a one-word term is that of the blank in front of it.
    """
    terms = vocab.filter(F.length("term") >= min_length)
    spaced = sents.withColumn("text", tx.dots_to_blanks(F.col("text")))
    words = _words(spaced, id_col, lambda text: F.split(text, " "))
    own = [id_col, "para_pos", "sent_pos", "offset"]
    hits = _matches(words, terms, own, (F.col("i") > 0) & (F.col("i") < F.col("n") - 1))
    start = F.col("start") - F.when(_several(F.col("term")), 0).otherwise(1)
    first = hits.groupBy(*own, "cat", "term").agg(F.min(start).alias("start"))
    return first.select(
        id_col, "cat", F.col("term").alias("word"), (F.col("offset") + F.col("start")).alias("doc_pos"), "para_pos", "sent_pos"
    )


def drop_noise(found: DataFrame, word: str = "word") -> DataFrame:
    """Drop mentions that are numbering or statistics residue."""
    return found.filter(~tx.is_noise(F.col(word)))


def concept_ids(found: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """Attach the concept id of a name, ``-1`` if the dictionary (key, concept_id) has none."""
    keyed = found.withColumn("_key", tx.name_key(F.col(word)))
    ids = dictionary.select(F.col("key").alias("_key"), "concept_id")
    return (
        keyed_join(keyed, ids, ["_key"], "left")
        .withColumn("concept_id", F.coalesce(F.col("concept_id"), F.lit("-1")))
        .drop("_key")
    )


def canonical_tokens(toks: DataFrame, synonyms: DataFrame, english: DataFrame, token: str = "token") -> DataFrame:
    """Replace a synonym by its canonical name unless it is a word of the given word list."""
    usable = synonyms.join(english.select(F.col("word").alias("synonym")), "synonym", "left_anti")
    known = usable.select(F.col("synonym").alias(token), "canonical")
    return keyed_join(toks, known, [token], "left").withColumn(
        "canonical", F.coalesce(F.col("canonical"), F.col(token))
    )


def word_counts(found: DataFrame, id_col: str = "article_id") -> DataFrame:
    return found.groupBy(id_col, "cat", "word").agg(F.count("*").alias("n"))


def words_containing(found: DataFrame, part: str, cat: str | None = None) -> DataFrame:
    keep: Column = F.col("word").contains(part)
    if cat:
        keep = keep & (F.col("cat") == cat)
    return found.filter(keep)


def phrase_scores(toks: DataFrame, min_count: int = 5, threshold: float = 10.0) -> DataFrame:
    """Adjacent word pairs that occur together more often than by chance.

    score = (n12 - min_count) * V / (n1 * n2), where V is the number of distinct words.
    ``toks`` holds the ordered token array of each sentence in ``tokens``; only counts are shuffled, and
    the counts are stored, since they are read as words, as pairs and for V, until the phrases are stored.
    """
    words = toks.select(F.filter("tokens", lambda t: t != "").alias("w"))
    # A word is counted with the one that follows it, the last of a sentence with none: all counts of a word make its own.
    grams = words.select("w", F.posexplode("w").alias("i", "w1")).select("w1", F.coalesce(F.get("w", F.col("i") + 1), F.lit("")).alias("w2"))
    counts = written(grams.groupBy("w1", "w2").agg(F.count("*").alias("n")), "grams")
    uni = written(counts.groupBy(F.col("w1").alias("w")).agg(F.sum("n").alias("n")), "words")
    pairs = counts.filter((F.col("w2") != "") & (F.col("n") >= min_count)).select("w1", "w2", F.col("n").alias("n12"))
    size = uni.agg(F.count("*"))
    scored = (
        pairs.join(uni.select(F.col("w").alias("w1"), F.col("n").alias("n1")), "w1")
        .join(uni.select(F.col("w").alias("w2"), F.col("n").alias("n2")), "w2")
        .withColumn("score", (F.col("n12") - min_count) * size.scalar() / (F.col("n1") * F.col("n2")))
    )
    phrases = written(scored.filter(F.col("score") > threshold).select("w1", "w2", "n12", "n1", "n2", "score"), "phrases")
    dropped(counts, uni)
    return phrases


def join_phrases(corpus: DataFrame, phrases: DataFrame, key_cols: list[str]) -> DataFrame:
    """Merge scored phrases greedily from the left: ``a b`` becomes ``a_b``; a merged word is not reused.

    The phrases that occur in a sentence are found by an equi-join on its adjacent pairs and gathered
    per sentence; where phrases overlap, one pass over their places decides.
    """
    last = F.greatest(F.size("tokens") - 1, F.lit(0))
    neighbours = F.zip_with(
        F.slice("tokens", F.lit(1), last),
        F.slice("tokens", F.lit(2), last),
        lambda a, b: F.struct(a.alias("w1"), b.alias("w2")),
    )
    adjacent = corpus.select(*key_cols, F.posexplode(neighbours).alias("i", "g")).select(
        *key_cols, "i", "g.w1", "g.w2"
    )
    hits = (
        keyed_join(adjacent, phrases.select("w1", "w2"), ["w1", "w2"], "left_semi")
        .groupBy(*key_cols)
        .agg(F.collect_set("i").alias("starts"))
    )
    marked = corpus.join(hits, key_cols, "left").withColumn("marks", merge_marks(F.col("starts"), F.size("tokens")))
    merged = F.transform(
        "tokens",
        lambda t, i: F.when(F.get("marks", i) == 1, F.concat(t, F.lit("_"), F.get("tokens", i + 1))).when(F.get("marks", i) == 0, t),
    )
    return marked.withColumn("tokens", F.filter(merged, lambda t: t.isNotNull())).drop("starts", "marks")
