"""Batch search: many queries against many entries, with blocking instead of comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.text import normalize_text
from statloom.operators.skew import top_rows
from statloom.session import materialize

# Points for the ways a term can match, and the bonus of an entry's type.
EXACT, PREFIX, WORD_PREFIX, ALL_TOKENS, INSIDE, ONE_TYPO, IN_TEXT = 100.0, 80.0, 60.0, 50.0, 30.0, 25.0, 10.0
ALIAS_FACTOR = 0.9
MIN_INSIDE, MIN_TYPO, MIN_TEXT = 4, 5, 3
TYPE_BONUS = {"state": 5, "ut": 5, "city": 3, "pillar": 4, "index": 2, "indicator": 0, "page": -2}


def search_index(parts: list[DataFrame]) -> DataFrame:
    """Union of projections (type, title, names, aliases, text) with everything normalised."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)

    def each(c: str) -> Column:
        values = F.coalesce(F.col(c), F.array().cast("array<string>"))
        return F.filter(F.array_distinct(F.transform(values, normalize_text)), lambda x: x != "")

    text = normalize_text(F.coalesce("text", F.lit("")))
    return out.select("type", "title", each("names").alias("names"), each("aliases").alias("aliases"), text.alias("text"))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def term_score(term: Column, query: Column, tokens: Column, substrings: bool) -> Column:
    """Points of one name or alias for one query."""
    words = _words(term)
    every = (F.size(tokens) > 1) & F.forall(tokens, lambda t: F.exists(words, lambda w: w.startswith(t)))
    score = (
        F.when(term == query, EXACT).when(term.startswith(query), PREFIX)
        .when(F.exists(words, lambda w: w.startswith(query)), WORD_PREFIX).when(every, ALL_TOKENS)
    )
    if substrings:
        score = score.when((F.length(query) >= MIN_INSIDE) & term.contains(query), INSIDE)
    typo = (F.length(query) >= MIN_TYPO) & F.exists(words, lambda w: F.levenshtein(w, query, 1) >= 0)
    return score.when(typo, ONE_TYPO).otherwise(0.0)


def _deletions(word: Column) -> Column:
    """The word and every form of it with one letter left out: two words within one edit share one."""
    cut = F.transform(
        F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1))
    )
    return F.array_distinct(F.concat(F.array(word), cut))


def _grams(text: Column, n: int = MIN_INSIDE) -> Column:
    last = F.length(text) - (n - 1)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(last >= 1, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def _rarest(asked: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per query the key that the fewest rows carry. `asked`: query, key; `sizes`: key, size.

    All keys of a query must match, so one decides; a key nobody carries leaves no candidate.
    """
    sized = asked.join(sizes, "key", "left").select("query", F.struct(F.coalesce("size", F.lit(0)).alias("size"), "key").alias("_k"))
    return sized.groupBy("query").agg(F.min("_k").alias("_k")).select("query", "_k.key")


def _names_with(names: DataFrame, queries: DataFrame) -> DataFrame:
    """(name, query) pairs in which the name holds the query, found by the rarest four-letter gram of the query."""
    distinct = names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    asked = queries.select("query", F.explode(_grams(F.col("query"))).alias("key"))
    grams = distinct.select("name", "n", F.explode(_grams(F.col("name"))).alias("key")).join(asked.select("key").distinct(), "key")
    by_gram = _rarest(asked, grams.groupBy("key").agg(F.sum("n").alias("size"))).join(grams.select("key", "name"), "key")
    return by_gram.filter(F.col("name").contains(F.col("query"))).select("name", "query")


def candidates(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(entry_id, query) pairs that may score.

    Entries are blocked through the dictionary of their distinct words: prefixes of words meet the
    rarest token of a query, one-letter deletions of words meet those of the whole query, and
    four-letter grams of names meet the rarest gram of the query. A word or gram that very many
    entries share never decides while the query has a rarer one.
    """
    tokens = queries.select("query", F.explode(F.array_distinct(_words(F.col("query")))).alias("key"))
    terms = F.concat("names", "aliases")
    words = F.array_distinct(F.concat(F.flatten(F.transform(terms, _words)), _words(F.col("text"))))
    posting = entries.select("entry_id", F.explode(words).alias("word"))
    dictionary = posting.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    starts = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substr(F.col("word"), F.lit(1), i))
    prefixes = dictionary.select("word", "n", F.explode(starts).alias("key")).join(tokens.select("key").distinct(), "key")
    by_prefix = _rarest(tokens, prefixes.groupBy("key").agg(F.sum("n").alias("size"))).join(prefixes.select("key", "word"), "key")
    long_words = dictionary.filter(F.length("word") >= MIN_TYPO - 1).select("word", F.explode(_deletions(F.col("word"))).alias("key"))
    long_queries = queries.filter(F.length("query") >= MIN_TYPO).select("query", F.explode(_deletions(F.col("query"))).alias("key"))
    by_typo = long_words.join(long_queries, "key").filter(F.levenshtein("word", "query", 1) >= 0)
    by_word = by_prefix.select("word", "query").unionByName(by_typo.select("word", "query")).distinct()
    posted = posting.join(by_word, "word").select("entry_id", "query")

    names = entries.select("entry_id", F.explode("names").alias("name"))
    inside = _names_with(names, queries)
    return posted.unionByName(names.join(inside, "name").select("entry_id", "query")).distinct()


def _by_title() -> list[Column]:
    return [F.length("title"), F.col("title"), F.col("entry_id")]


def _postings(entries: DataFrame) -> DataFrame:
    """A row per entry and word: kind (name, alias, text), and whether the word begins or is its whole term; also whole names."""

    def spelled(kind: str, terms: Column) -> Column:
        def of_one(term: Column) -> Column:
            words = _words(term)
            of_text = F.lit(kind == "text")
            return F.transform(
                words, lambda w, i: F.struct(
                    F.lit(kind).alias("kind"), w.alias("word"), ((i == 0) & ~of_text).alias("first"), ((F.size(words) == 1) & ~of_text).alias("whole")
                )
            )

        return F.flatten(F.transform(terms, of_one))

    full = F.transform(
        "names", lambda n: F.struct(F.lit("full").alias("kind"), n.alias("word"), F.lit(False).alias("first"), F.lit(False).alias("whole"))
    )
    terms = [spelled("name", F.col("names")), spelled("alias", F.col("aliases")), spelled("text", F.array("text")), full]
    every = F.array_distinct(F.concat(*terms))
    return entries.select("entry_id", "type", "title", F.explode(every).alias("_p")).select("entry_id", "type", "title", "_p.*")


def best_candidates(entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(entry_id, query) pairs that hold the best k entries of every one-word query.

    All entries of one type that match a query in the same way have the same score there, so of each
    such list only the first k by title can be among the best: whoever is missing from the list
    of its best match has k entries before it. Lists are made from short to shorter: k rows per word, then
    k per beginning of a word, each kept by the tasks before the shuffle, so neither a word that every entry
    holds nor a query of one letter meets more than k rows a task and list.
    """
    heads = materialize(top_rows(_postings(entries), ["kind", "first", "whole", "type", "word"], _by_title(), k).drop("position"), "postings")
    row, word = ["type", "title", "entry_id"], F.col("word")
    starts = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substr(word, F.lit(1), i))
    # Words are met by their beginnings, names by their grams: a gram is a query of its own.
    own = heads.select(
        *row, F.concat("kind", F.col("first").cast("string")).alias("list"),
        F.explode(F.when(F.col("kind") == "full", _grams(word)).otherwise(starts)).alias("query"),
    )
    whole = heads.filter("whole").select(*row, F.concat(F.lit("whole "), "kind").alias("list"), word.alias("query"))

    titled, names = heads.filter("kind in ('name', 'alias')"), heads.filter("kind = 'full'").withColumnRenamed("word", "name")
    long_words = titled.filter(F.length(word) >= MIN_TYPO - 1).select("word").distinct()
    long_queries = queries.filter(F.length("query") >= MIN_TYPO)
    near = long_words.select("word", F.explode(_deletions(word)).alias("key")).join(
        long_queries.select("query", F.explode(_deletions(F.col("query"))).alias("key")), "key"
    ).filter(F.levenshtein("word", "query", 1) >= 0).select("word", "query").distinct()
    mistyped = titled.join(near, "word").select(*row, F.concat(F.lit("like "), "kind").alias("list"), "query")
    # Longer queries are looked up by their rarest gram.
    holding = names.join(_names_with(names, long_queries), "name").select(*row, F.lit("inside").alias("list"), "query")

    lists = own.unionByName(whole).unionByName(mistyped).unionByName(holding)
    kept = top_rows(lists, ["query", "list", "type"], _by_title(), k)
    return kept.select("query", "entry_id").join(queries, "query", "left_semi").distinct()


def _scored(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Scores of (entry_id, query) pairs, those that do not match at all left out."""
    pairs = pairs.join(entries, "entry_id").withColumn("_tokens", _words(F.col("query")))
    q, tokens = F.col("query"), F.col("_tokens")
    best_name = F.array_max(F.transform("names", lambda n: term_score(n, q, tokens, True)))
    best_alias = F.array_max(F.transform("aliases", lambda a: term_score(a, q, tokens, False))) * ALIAS_FACTOR
    best = F.greatest(F.coalesce(best_name, F.lit(0.0)), F.coalesce(best_alias, F.lit(0.0)))
    scored = pairs.withColumn("_best", best)
    in_text = (F.length(q) >= MIN_TEXT) & F.forall(tokens, lambda t: F.exists(_words(F.col("text")), lambda w: w.startswith(t)))
    matched = F.when(F.col("_best") > 0, F.col("_best")).when(in_text, IN_TEXT).otherwise(0.0)
    bonus = F.create_map(*[F.lit(x) for pair in TYPE_BONUS.items() for x in pair])[F.col("type")]
    return scored.withColumn("_m", matched).filter("_m > 0").select(
        "query", "entry_id", "type", "title", (F.col("_m") + bonus).alias("score")
    )


def score_terms(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """Score of every (entry, query) pair that matches at all.

    Names count in full, aliases 0.9 and never inside a word; the description only when nothing
    else matches and every token starts one of its words. Entries and queries are read many times, hence
    written once.
    """
    entries, queries = materialize(entries, "entries"), materialize(queries, "queries")
    return _scored(candidates(entries, queries), entries)


def search(entries: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """Best k entries per query: score, then the shorter title, then the title.

    `entries`: entry_id and the columns of search_index; `queries`: raw. One-word queries, which may
    match very many entries, score only the heads of their lists (best_candidates); queries of several
    words score what holds their rarest one. Spark keeps k rows per query in each task before the shuffle.
    """
    asked = queries.select(normalize_text(F.col("raw")).alias("query")).filter("query <> ''").distinct()
    entries, asked = materialize(entries, "entries"), materialize(asked, "queries")
    one_word = ~F.col("query").contains(" ")
    pairs = best_candidates(entries, asked.filter(one_word), k).unionByName(candidates(entries, asked.filter(~one_word)).select("query", "entry_id"))
    return top_rows(_scored(pairs, entries), ["query"], [F.col("score").desc(), *_by_title()], k)
