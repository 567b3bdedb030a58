"""Verbs of a text as lemmas: ending rules, a table of irregular forms, a lexicon of base forms.

A word is a verb if the rules lead from it to a base form of the lexicon. A
word with a verb's ending (or an irregular form) is of rank 1; a bare base
form, or one with an s, can be a noun as well and is of rank 2. Words of rank 2
count only in texts without one of rank 1.

Two ways, same result: with the lexicon in the expression everything stays in
the row, and a word costs a few hash lookups; with the lexicon as a table, of
any size, distinct words are joined to it, and only what is found is grouped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import settle

SMALL_LEXICON = 100_000  # base forms that are sent to every task

# Base forms known without a table. Rare verbs belong in a lexicon table.
BASES = """
accept add answer arrive ask assist attach avoid bang become begin believe bend bite bleed blow break bring bruise build bump
burn burst buy call carry catch change chop choose clean climb close collapse collide come complete continue cover crack
crawl create crush cry cut damage decide deliver descend develop die dig dislocate dive drag draw drill drink drive drop
eat enter explode fall feed feel fight fill find finish fly follow forget fracture get give go grab grind grow handle hang
happen hear help hit hold hurt include inhale injure irritate jar jump keep kick kneel know lacerate lay lead learn
leave lend let lie lift listen live load lose make mean meet move need open operate pay pinch pierce play pour pry pull
puncture push put quit reach read receive release remove repair ride ring rise roll rotate run say scrape scratch see sell
send set shake show shut sing sink sit slam sleep slide slip speak spill spin sprain stand start state step stick sting stop
strain stress stretch strike stumble swell swim swing take talk teach tear tell think throw touch trip try turn twist
understand unload use wait wake walk want wash wear weld win work write
"""

# Irregular forms, as "base: forms".
IRREGULAR = """
become: became; begin: began begun; bend: bent; bite: bit bitten; bleed: bled; blow: blew blown; break: broke broken;
bring: brought; build: built; burn: burnt; buy: bought; catch: caught; choose: chose chosen; come: came; die: dying;
dig: dug; draw: drew drawn; drink: drank drunk; drive: drove driven; eat: ate eaten; fall: fell fallen; feed: fed;
feel: felt; fight: fought; find: found; fly: flew flown; forget: forgot forgotten; get: got gotten; give: gave given;
go: went gone; grind: ground; grow: grew grown; hang: hung; hear: heard; hold: held; keep: kept; kneel: knelt;
know: knew known; lay: laid; lead: led; leave: left; lend: lent; lie: lying lain; lose: lost; make: made; mean: meant;
meet: met; pay: paid; ride: rode ridden; ring: rang rung; rise: rose risen; run: ran; say: said; see: saw seen;
sell: sold; send: sent; shake: shook shaken; show: shown; sing: sang sung; sink: sank sunk; sit: sat; sleep: slept;
slide: slid; speak: spoke spoken; spin: spun; stand: stood; stick: stuck; sting: stung; strike: struck stricken;
swell: swollen; swim: swam swum; swing: swung; take: took taken; teach: taught; tear: tore torn; tell: told;
think: thought; throw: threw thrown; understand: understood; wake: woke woken; wear: wore worn; win: won; write: wrote written
"""

DOUBLED = r"([bdfglmnprstvz])\1$"


def bases(text: str = BASES) -> list[str]:
    return text.split()


def irregular_forms(text: str = IRREGULAR) -> dict[str, str]:
    """Form to base form."""
    entries = (e.split(":") for e in " ".join(text.split()).split(";"))
    return {form: base.strip() for base, forms in entries for form in forms.split()}


def _tail(word: Column, n: int, more: str = "") -> Column:
    cut = F.substring(word, F.lit(1), F.length(word) - n)
    return F.concat(cut, F.lit(more)) if more else cut


def _past(stem: Column) -> list[Column]:
    """Base forms in front of -ed or -ing: with a silent e, as it is, without a doubled consonant."""
    return [F.concat(stem, F.lit("e")), stem, F.when(stem.rlike(DOUBLED), _tail(stem, 1))]


def candidates(word: Column) -> list[tuple[int, list[Column]]]:
    """Base forms that a word may come from, by rank, the first known one of a rank to be taken."""
    inflected = [F.when(word.endswith(end), c) for end, n in (("ing", 3), ("ed", 2)) for c in _past(_tail(word, n))]
    inflected += [F.when(word.endswith("ied"), _tail(word, 3, "y"))]
    plain = [word, F.when(word.endswith("ies"), _tail(word, 3, "y")), F.when(word.endswith("es"), _tail(word, 2))]
    return [(1, inflected), (2, [*plain, F.when(word.endswith("s"), _tail(word, 1))])]


def lemma_in_row(word: Column, known: Sequence[str], irregular: dict[str, str]) -> Column:
    """Rank and lemma of a word as one text (``1lift``); null if it is no verb. Known forms are looked up as a hash set."""
    out = [F.when(word.isin(list(irregular)), _chosen(word, irregular))] if irregular else []
    for rank, options in candidates(word):
        found = [F.when(c.isin(list(known)), F.concat(F.lit(str(rank)), c)) for c in options]
        out.append(F.coalesce(*found))
    return F.coalesce(*out)


def _chosen(word: Column, irregular: dict[str, str]) -> Column:
    """The base of an irregular form; asked only for words that are one."""
    listed = F.split(F.lit(";".join(irregular)), ";")
    lemmas = F.split(F.lit(";".join(f"1{base}" for base in irregular.values())), ";")
    return F.element_at(lemmas, F.array_position(listed, word).cast("int"))


def first_two(hits: Column) -> tuple[Column, Column]:
    """First and second lemma of the best rank among hits in order (``1lift``); null where there is none."""
    rank = F.substring(F.array_min(hits), 1, 1)
    best = F.filter(hits, lambda h: F.substring(h, 1, 1) == rank)
    return tuple(F.substring(F.get(best, F.lit(n)), 2, 1_000) for n in (0, 1))


def text_verbs(
    texts: DataFrame, key: str, words: Column, lexicon: DataFrame, irregular: dict[str, str] | None = None, base: str = "base"
) -> DataFrame:
    """First and second verb of each text, and how many it has, with the base forms in a table.

    ``words``: an array of words in small letters. Candidates are made once for
    each distinct word and joined to the lexicon by hash (sent to every task if
    it has at most ``SMALL_LEXICON`` rows); the words that are verbs are then
    looked up in the texts (likewise, else by shuffle, where a frequent word is
    split by AQE). A text without verbs, a null text and a row without key have
    nulls and 0. The key tells texts apart.
    """
    irregular = irregular_forms() if irregular is None else irregular
    word = F.col("word")
    options = [F.struct(F.lit(1).alias("rank"), F.lit(0).alias("turn"), _irregular(word, irregular).alias("form"))] if irregular else []
    for rank, columns in candidates(word):
        options += [F.struct(F.lit(rank).alias("rank"), F.lit(i + 1).alias("turn"), c.alias("form")) for i, c in enumerate(columns)]
    vocabulary = texts.select(F.explode(words).alias("word")).filter(F.length("word") > 1).distinct()
    asked = vocabulary.select("word", F.explode(F.filter(F.array(*options), lambda o: o["form"].isNotNull())).alias("o"))
    known = lexicon.select(F.col(base).alias("__base")).filter("__base is not null").distinct()
    known = F.broadcast(known) if lexicon.limit(SMALL_LEXICON + 1).count() <= SMALL_LEXICON else known
    of_word = asked.join(known, F.col("o.form") == F.col("__base")).groupBy("word").agg(F.min("o").alias("o"))  # its best candidate
    verbs = settle(of_word.select("word", "o.*"), "verb-forms")
    verbs = F.broadcast(verbs) if verbs.count() <= SMALL_LEXICON else verbs
    rows = texts.select(F.col(key).alias("__key"), F.posexplode(words).alias("place", "word"))
    hits = rows.join(verbs, "word").select("__key", "place", "rank", "turn", "form")
    # all that is found of a text comes together once: a few entries for each of its verbs
    listed = hits.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("place", "rank", "turn", "form"))).alias("__hits"))
    earlier = F.filter("__hits", lambda h, i: (i == 0) | (F.get("__hits", i - 1)["place"] != h["place"]))  # a word's best candidate
    listed = listed.withColumn("__hits", F.transform(earlier, lambda h: F.concat(h["rank"].cast("string"), h["form"])))
    first, second = first_two(F.col("__hits"))
    best = F.filter("__hits", lambda h: F.substring(h, 1, 1) == F.substring(F.array_min("__hits"), 1, 1))
    found = listed.select("__key", first.alias("verb"), second.alias("second_verb"), F.size(best).alias("n_verbs"))
    out = texts.select(key).join(found, F.col(key) == F.col("__key"), "left").drop("__key")
    return out.withColumn("n_verbs", F.coalesce("n_verbs", F.lit(0)).cast("long"))


def _irregular(word: Column, irregular: dict[str, str]) -> Column:
    return F.when(word.isin(list(irregular)), F.substring(_chosen(word, irregular), 2, 1_000))
