"""Operator 11: groups of spelling variants, by walking the words through their own trie.

The trie is three tables. `edges` has a row for each node and letter: the child,
and a signature of the rests of words below it; where a word ends, an edge
without a letter leads back to its node. `ends` leads from a node with few
letters to go to the word they end. `jumps` crosses levels where more are left:
the largest power of two in their number, so that a word of any length is walked
in as many rounds as that number has bits. A node is the 64-bit hash of its
prefix; should two prefixes share one, both are walked, and what is found is
verified by the words themselves.

A state is (word, node, rest of the word, edits). Without an edit a word stands
on its own path; states start there, one for each position. The first join with
the edges makes the edit: the letter is replaced, another one comes before it,
or it is left out; only where the signature has what is then left does a state
go on. After that each round joins the states with the jumps, and the last one
with the ends: those are the neighbours.

Near the root a node has so many children that every word would walk all of
them. But a word and its neighbour agree in the first half or in the second:
words are walked forwards from their middle on, and backwards, in the trie of
the reversed words, likewise. No pair is lost, and the states of a word are a
dozen.

Edges and first states are of the same places of the same words, so both are
made from one exchange of places, dealt by node; what such a row is to hold is
told by the word and the place alone, and so derived behind the exchange. Long
words, of which a copy for each place would be large, go apart.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, key_text, table

#: Code points of the shortest words, their least number of occurrences, how much more often a form must stand.
LEAST, OFTEN, RATIO = 7, 2, 10
#: Of the runs, those whose CRC this divides lose a letter.
GARBLED = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rest of fewer letters is crossed at once; no word of up to SHORT letters has a longer one after its middle.
FEW = 16
SHORT = 2 * FEW - 2
#: A signature of rests is so many numbers of 64 bits, with one bit of each for a rest. It is never shuffled.
PARTS = 4


def cut(text: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """Code points from `start`, counted from 0; to the end without a length."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit((1 << 31) - 1) if length is None else F.lit(length) if isinstance(length, int) else length
    return text.substr(start.cast("int") + 1, length.cast("int"))


def words_of(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """word, n: the runs of Latin letters that have `least` code points and stand `often` times or more.

    A-Z are lowered. A run whose CRC-32, with the document's key before it, is a
    multiple of GARBLED loses the letter that the CRC points to, wherever it
    stands in that document. Null and empty texts have no words; a null key is
    `null`. Repeated rows count each time.
    """
    runs = F.regexp_extract_all(F.translate(docs[text], UPPER, LOWER), F.lit(rf"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))
    found = docs.select(key_text(docs[key]).alias("key"), F.explode(runs).alias("run"))
    found = found.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(cut(F.col("run"), 0, at), cut(F.col("run"), at + 1))
    found = found.select(F.when(F.col("h") % GARBLED == 0, shorter).otherwise(F.col("run")).alias("word"))
    return found.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def _letter(text: Column) -> Column:
    """Its first code point; -1 of an empty text."""
    return F.coalesce(F.when(text != "", F.ascii(text)), F.lit(-1))


def _sign(rest: Column) -> Column:
    """Which bits of a signature stand for a rest: six bits of the sign for each part."""
    return F.xxhash64(rest).bitwiseAND(F.lit((1 << 6 * PARTS) - 1)).cast("int")


def _bit(sign: Column, part: int) -> Column:
    return F.call_function("shiftright", sign, F.lit(6 * part)).bitwiseAND(F.lit(63))


def _signature(sign: Column) -> list[Column]:
    return [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(sign, i))).alias(f"part{i}") for i in range(PARTS)]


def _fits(sign: Column) -> Column:
    """Whether the signature may hold the rest of this sign; if not, that rest is not there."""
    return functools.reduce(lambda a, b: a & b, (F.getbit(F.col(f"part{i}"), _bit(sign, i)) == 1 for i in range(PARTS)))


def _node(side: Column, prefix: Column) -> Column:
    return F.xxhash64(side, prefix)


def _jump(rest: Column) -> Column:
    """How many of so many letters are crossed at once."""
    return F.when(rest < FEW, rest).otherwise(F.call_function("shiftleft", F.lit(1), F.length(F.bin(rest)) - 1))


def _jump_key(node: Column, rest: Column) -> Column:
    r = F.length(rest)
    return F.xxhash64(node, cut(rest, 0, _jump(r)), r)


def _end_key(node: Column, rest: Column) -> Column:
    return F.xxhash64(node, rest)


def _both_ways(words: DataFrame) -> DataFrame:
    """n, side (0 forwards, 1 backwards), w, size."""
    ways = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("w")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("w"))))
    return words.select("n", ways.alias("x")).select("n", "x.side", "x.w", F.length("x.w").alias("size"))


def _there_and_back() -> Column:
    """The word as it is read."""
    return F.when(F.col("side") == 0, F.col("w")).otherwise(F.reverse("w"))


def _dealt(rows: DataFrame, by: Column, short: bool, **made: Column) -> DataFrame:
    """The columns made of rows that are dealt by one of them, `by`: of short words behind the exchange, so that it carries the rows alone."""
    rows = rows.repartition(by) if short else rows
    rows = rows.select(*[c.alias(name) for name, c in made.items()])
    return rows if short else rows.repartition(next(iter(made)))


def places(words: DataFrame, short: bool) -> DataFrame:
    """node, child, rest, id, starts: each place of each word, both ways, from the depth on that a neighbour's middle can have, dealt by node.

    The child is one letter on, or the node itself at the end. A state starts where `starts` holds.
    """
    w, p, side, size = F.col("w"), F.col("p"), F.col("side"), F.length("w")
    at = F.explode(F.sequence(F.floor((F.col("size") - 1) / 2).cast("int"), F.col("size")))
    first = F.when(side == 0, F.floor(size / 2)).otherwise(F.ceil(size / 2))
    node = _node(side, cut(w, 0, p))
    rows = _both_ways(words).select("side", "w", at.alias("p"))
    return _dealt(rows, node, short, node=node, child=_node(side, cut(w, 0, p + 1)), rest=cut(w, p), id=F.xxhash64(_there_and_back()), starts=p >= first)


def trie_edges(at: DataFrame) -> DataFrame:
    """node, letter, child and the parts of a signature: the edges of the places, with the rests below the child."""
    rest = F.col("rest")
    rows = at.select("node", _letter(rest).alias("letter"), "child", _sign(cut(rest, 1)).alias("sign"))
    return rows.groupBy("node", "letter", "child").agg(*_signature(F.col("sign")))


def trie_ends(words: DataFrame, short: bool) -> DataFrame:
    """key, near, near_n: the word that ends a rest of fewer than FEW letters, by the node and that rest; dealt by key."""
    w, p, side = F.col("w"), F.col("p"), F.col("side")
    lowest = F.greatest(F.floor((F.col("size") + 1) / 2).cast("int"), F.col("size") - (FEW - 1))
    rows = _both_ways(words).select("n", "side", "w", F.explode(F.sequence(lowest, F.col("size"))).alias("p"))
    key = _end_key(_node(side, cut(w, 0, p)), cut(w, p))
    return _dealt(rows, key, short, key=key, near=_there_and_back(), near_n=F.col("n"))


def trie_jumps(words: DataFrame) -> DataFrame:
    """key, child: where FEW letters or more are left, by the node, those crossed and the number left; dealt by key."""
    w, p, size = F.col("w"), F.col("p"), F.col("size")
    rows = _both_ways(words).where(size - F.floor((size + 1) / 2) >= FEW)
    rows = rows.select("side", "w", "size", F.explode(F.sequence(F.floor((size + 1) / 2).cast("int"), size - FEW)).alias("p"))
    key = _jump_key(_node(F.col("side"), cut(w, 0, p)), cut(w, p))
    child = _node(F.col("side"), cut(w, 0, p + _jump(size - p)))
    return rows.select(key.alias("key"), child.alias("child")).repartition("key").distinct()


def edited(at: DataFrame) -> DataFrame:
    """The states after one edit: id, node, rest.

    The edit stands where a word leaves its own path, so the edge's letter is not the word's.
    """
    rest = F.col("rest")
    # What is tried against each edge are numbers alone; places where no state starts have no sign, as they are there for the edges.
    signs = [F.when(F.col("starts"), _sign(cut(rest, used))).alias(f"sign{used}") for used in range(3)]
    zero = at.select("node", "id", "rest", _letter(rest).alias("first"), _letter(cut(rest, 1)).alias("second"), *signs)
    walked = zero.join(trie_edges(at).withColumnRenamed("node", "from"), F.col("node") == F.col("from"))
    letter, fits = F.col("letter"), lambda used: _fits(F.col(f"sign{used}"))
    spent = {
        1: (F.col("first") >= 0) & (letter >= 0) & fits(1),  # replaced
        0: (letter >= 0) & fits(0),  # another before it
        2: (letter == F.col("second")) & fits(2),  # left out, and the next one matched; or the word ends there
    }
    found = walked.where((letter != F.col("first")) & (spent[0] | spent[1] | spent[2]))
    found = found.select("id", "child", "rest", F.explode(F.array(*[F.when(ok, F.lit(used)) for used, ok in spent.items()])).alias("used")).where("used IS NOT NULL")
    return found.select("id", F.col("child").alias("node"), cut(rest, F.col("used")).alias("rest"))


def _walked(words: DataFrame, longest: int) -> DataFrame:
    """id, near, near_n: what the words of up to `longest` letters reach, among them all their neighbours."""
    short = longest <= SHORT
    states = edited(places(words, short))
    rest, going = F.col("rest"), F.length("rest") >= FEW
    rounds = 0 if short else ((longest + 1) // 2).bit_length() - FEW.bit_length() + 1
    jumps = trie_jumps(words) if rounds else None
    for _ in range(rounds):
        # What has few letters left goes along under a key of its own.
        keyed = states.select("id", going.alias("going"), F.when(going, _jump_key(F.col("node"), rest)).otherwise(F.xxhash64("id", "node")).alias("key"), F.when(~going, F.col("node")).alias("node"), F.when(going, cut(rest, _jump(F.length(rest)))).otherwise(rest).alias("rest"))
        states = keyed.join(jumps, "key", "left").where("NOT going OR child IS NOT NULL")
        states = states.select("id", F.when(F.col("going"), F.col("child")).otherwise(F.col("node")).alias("node"), "rest")
    # A key tells all of a state: only the word goes with it.
    return states.select("id", _end_key(F.col("node"), rest).alias("key")).join(trie_ends(words, short), "key").select("id", "near", "near_n")


def neighbours(words: DataFrame) -> DataFrame:
    """word, near, near_n: all pairs, both ways, of different words that one inserted, deleted or replaced code point makes equal.

    words has word, n; the words are distinct, and null and empty ones have no
    neighbours. Rows come dealt by the hash of word, those of a word together.
    """
    words = words.select("word", "n").where("word <> ''")
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    found = _walked(words if longest <= SHORT else words.where(F.length("word") <= SHORT), SHORT)
    if longest > SHORT:  # neighbours differ by a letter in length at most: a pair that is not wholly among the short ones is here
        found = found.union(_walked(words.where(F.length("word") >= SHORT), longest))
    found = found.join(words.select(F.xxhash64("word").alias("id"), "word"), "id")
    return found.where(F.levenshtein("word", "near", 1) == 1).select("id", "word", "near", "near_n").distinct()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of words (word, n), whose words are distinct.

    The form is the near word that stands most often, ties to the smallest by
    code points, if it stands `ratio` times as often or more; the root is the
    end of the forms' chain. A null or empty word has no neighbours. No words
    give no rows.
    """
    if ratio < 2:
        raise ValueError("a form must stand twice as often as its word, or more")
    words = checkpoint(words.select("word", "n"))
    near = neighbours(words).groupBy("id", "word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(near.drop("id"), "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    known = checkpoint(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    # A form stands `ratio` times as often as its word, so chains are short; each round doubles what is followed of them.
    most = known.agg(F.max("n")).first()[0] or 1
    links = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(int(math.log(most, ratio) + 1).bit_length()):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = checkpoint(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return known.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words_of(table(spark, sf_dir, "documents")))


#: The letters from À on, and as many signs of one byte, so that edits are counted by letters.
_WIDE = "".join(map(chr, range(0xC0, 0x100)))
_NARROW = "".join(map(chr, range(0x21, 0x61))).replace("'", "''")

ORACLE = f"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS n FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM bits WHERE n < 8),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE n = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents),
lowered AS (SELECT k, translate(raw, '{UPPER}', '{LOWER}') AS run FROM runs WHERE length(raw) >= {LEAST}),
hashed AS (
  SELECT run, CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(k || ':' || run)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
    lambda a, b: xor(tab[CAST(xor(a, b) & 255 AS BIGINT) + 1], a >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS BIGINT) AS h
  FROM lowered, crc_table),
garbled AS (SELECT CASE WHEN h % {GARBLED} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n, translate(word, '{_WIDE}', '{_NARROW}') AS narrow FROM garbled WHERE length(word) >= {LEAST} GROUP BY word HAVING count(*) >= {OFTEN}),
-- Words an edit apart are equal before their middle or after it.
halves AS (
  SELECT *, 0 AS side, length(word) AS size, unnest([length(word) // 2, (length(word) - 1) // 2, (length(word) + 1) // 2]) AS cut FROM words
  UNION SELECT *, 1, length(word), unnest([(length(word) + 1) // 2, length(word) // 2, (length(word) + 2) // 2]) FROM words),
met AS (SELECT *, CASE WHEN side = 0 THEN left(word, cut) ELSE right(word, cut) END AS half FROM halves),
pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM met a JOIN met b ON a.side = b.side AND a.half = b.half AND abs(a.size - b.size) <= 1 AND a.word <> b.word
  WHERE levenshtein(a.narrow, b.narrow) = 1),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
known AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at, form AS next FROM known UNION ALL SELECT c.word, k.word, k.form FROM chain c JOIN known k ON c.next = k.word)
SELECT k.word, form, c.at AS root, n, n_near, form_n FROM known k JOIN chain c ON c.word = k.word AND c.next IS NULL
"""

QUERIES = {"op11_spelling": op11_spelling}
ORACLES = {"op11_spelling": ORACLE}
