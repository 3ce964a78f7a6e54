"""Text cut off by field limits or in transfer.

Pure SQL: word trigrams, with runs of five and two words and single words where they are too rare or too common, are
counted inside texts and at ends of sentences and texts. A text whose final run often goes on elsewhere and almost never ends
there was cut; so was one whose last word is no word of the corpus but the beginning of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.scratch import materialise

BROADCAST_KEYS = 500_000
#: A final run is terminal if this share of its other occurrences are.
CLOSES = 0.3
#: Occurrences from which on a run is evidence.
EVIDENCE = 3
#: A sign after a final run does not close a sentence (an abbreviation, a quoted cry): text went on past it this often, and
#: almost never began anew.
GOES_PAST = (10, 0.02)

# Signs that stand around words without ending anything.
_QUIET = '()[]{}"“”„«»*'
# Signs that are words of their own wherever they stand.
_APART = ",;:!?#…\n"

# Texts without their end mark and final white space, with what their punctuation says.
_BODIES = r"""
SELECT doc_id, source, chars, body, marked, right(body, 1) last_char, xxhash64(body) content,
       rlike(body, r'[.!?][)\]\x22“”»’\x27 ]*$') closed,
       (length(body) - length(replace(body, '"', ''))) % 2 = 1
         OR rlike(body, r'(?<![:;8=-])\([^()]*$') OR rlike(body, r'«[^»]*$') OR rlike(body, r'„[^“”]*$') open,
       CASE WHEN instr(body, '\n') > 0 THEN trim(substring_index(body, '\n', -1)) END last_line
FROM (SELECT doc_id, source, chars, marked, IF(marked, regexp_replace(bare, r'\s*(?:[\[(](?:\.{2,}|…)[)\]]|\.{2,}|…)$', ''), bare) body
      FROM (SELECT doc_id, source, length(text) chars, rlike(text, r'(?:\.{2,}|…)[)\]\s ]*$') marked, regexp_replace(replace(text, '\r', ''), r'[\s ]+$', '') bare FROM docs))
"""


def _spaced(text: str) -> str:
    """Words and signs with one blank between them; a full stop is a sign only before white space or at the end."""
    out = f"translate({text}, '{_QUIET}\t ', repeat(' ', {len(_QUIET) + 2}))"
    out = f"replace(replace({out}, '...', '…'), '..', '…')"
    for sign in _APART:
        shown = "\\n" if sign == "\n" else sign
        out = f"replace({out}, '{shown}', ' {shown} ')"
    return f"trim(regexp_replace(replace(concat({out}, ' '), '. ', ' . '), ' {{2,}}', ' '))"


# Each text as blank-separated words twice: in lower case, and with numbers and capitalised words standing for their kind.
_TOKENS = f"""
SELECT doc_id, source, chars, marked, closed, open, last_line, last_char, content, lower(words) low,
       lower(regexp_replace(regexp_replace(words, r'\\d++', '0'), r'\\p{{Lu}}\\p{{L}}++', '¤')) kinds
FROM (SELECT *, {_spaced("body")} words FROM bodies)
"""

# Positions of the last word and the runs that end in it; the signs that end sentences, dots and line ends do not count as words.
_FINALS = r"""
SELECT * EXCEPT (low, kinds, l, at, g, ending), try_element_at(l, -1) last_sign, CASE WHEN at > 0 THEN element_at(l, at) END word,
       CASE WHEN at > 0 THEN array(xxhash64(g[0], g[1], g[2], g[3], g[4]), xxhash64(g[2], g[3], g[4]), xxhash64(g[3], g[4])) END runs
FROM (SELECT * EXCEPT (a), transform(sequence(at - 4, at), i -> xxhash64(IF(i < 1, '^', a[i - 1]))) g
      FROM (SELECT *, split(kinds, ' ') a, split(low, ' ') l, IF(ending = '', 0, size(split(ending, ' '))) at
            FROM (SELECT *, regexp_replace(low, r'(?:(?:^| )[.!?…\n])+$', '') ending FROM tokens)))
"""

# Texts that occur more than once; one row of each stands for all of them as evidence.
_COPIES = "SELECT content, marked, min(row_id) first FROM tokens GROUP BY content, marked HAVING count(*) > 1"
_TEXTS = "SELECT t.marked, t.low, t.kinds FROM tokens t LEFT JOIN copies c ON t.content = c.content AND t.marked = c.marked WHERE c.first IS NULL OR t.row_id = c.first"

# What a word does to the one before it: 1 a full stop, 2 another end sign, 3 dots or a line end, 4 begins a sentence, 0 goes on.
_KIND = r"""CASE WHEN x = '.' THEN 1 WHEN x IN ('!', '?') THEN 2 WHEN x IN ('…', '\n') THEN 3 WHEN x >= 'a' AND x < '{' THEN IF(contains(x, '.'), 4, 0)
  WHEN x = '0' OR left(x, 1) >= 'ß' THEN 0 ELSE 4 END"""

_POSITIONS = f"""
SELECT stack(4, h5, h3, h2, word) key, CASE WHEN n1 = 9 THEN IF(marked, 'marked', 'bare') WHEN n1 = 3 THEN 'stop' WHEN n1 IN (1, 2) THEN IF(n2 <> 0, 'stop', 'past') ELSE 'on' END follows
FROM (SELECT marked, xxhash64(g.`0`, g.`1`, g.`2`, g.`3`, g.`4`) h5, xxhash64(g.`2`, g.`3`, g.`4`) h3, xxhash64(g.`3`, g.`4`) h2, g.l word, g.`5` own, g.`6` n1, g.`7` n2
      FROM (SELECT marked, explode(arrays_zip(slice(h, 1, n), slice(h, 2, n), slice(h, 3, n), slice(h, 4, n), slice(h, 5, n), slice(k, 1, n), slice(k, 2, n), slice(k, 3, n), l)) g
            FROM (SELECT marked, size(a) n, transform(l, x -> xxhash64(1, x)) l, concat(array_repeat(xxhash64('^'), 4), transform(a, x -> xxhash64(x))) h, concat(transform(a, x -> {_KIND}), array(9, 9)) k
                  FROM (SELECT marked, split(kinds, ' ') a, split(low, ' ') l FROM texts WHERE kinds <> ''))))
WHERE own NOT IN (1, 2, 3)
"""

_COUNTS = """
SELECT key, count_if(follows IN ('on', 'past')) goes_on, count_if(follows = 'past') past, count_if(follows = 'stop') stops, count_if(follows = 'marked') trails, count_if(follows = 'bare') bare
FROM positions JOIN wanted USING (key) GROUP BY key
"""

# Final words that stand nowhere inside a text, and whether the corpus has longer words that begin like them.
_FRAGMENTS = r"""
SELECT DISTINCT u.word fragment FROM
  (SELECT DISTINCT word FROM tokens LEFT JOIN counts ON key = keys[3] WHERE rlike(word, r'^\p{L}[^\d.]*$') AND coalesce(goes_on + stops, 0) = 0) u
JOIN (SELECT word, explode(transform(sequence(1, length(word) - 1), i -> left(word, i))) stem
      FROM (SELECT DISTINCT explode(split(low, ' ')) word FROM texts) WHERE rlike(word, r'^\p{L}{2}')) v ON v.stem = u.word
"""

_LINES = "SELECT last_line, count(DISTINCT content) n FROM tokens WHERE last_line IS NOT NULL GROUP BY last_line HAVING count(DISTINCT content) >= {evidence}"

# A length at which many different texts of a source end, mostly unclosed, with hardly any a little longer: a field's limit.
_LIMITS = """
SELECT source, chars top FROM (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY chars RANGE BETWEEN 1 FOLLOWING AND 25 FOLLOWING), 0) above,
         coalesce(sum(n) OVER (PARTITION BY source ORDER BY chars RANGE BETWEEN 25 PRECEDING AND 3 PRECEDING), 0) / 23 below
  FROM (SELECT source, chars, count(*) n, count(DISTINCT content) texts, count_if(NOT closed) unclosed FROM tokens GROUP BY source, chars))
WHERE texts >= 5 AND n >= 3 * below AND above <= 0.2 * n AND unclosed >= 0.6 * n
"""

_LAST_BLOCK = (
    r"^(?:--|—|–)\s*\S|^(?:#[\p{L}\d_]+\s*)+$|^\s*(?:[-*•]|\d+[.)])\s+\S|^\S*\d\S*\.[A-Za-z][A-Za-z0-9]{2,3}$|\d[.,]\d{2}$|^[^\p{L}]*$"
)

# The reason of each verdict: those that begin with 'cut' were cut. Runs are asked before signs and lengths.
_VERDICT = r"""
SELECT doc_id, source, reason, startswith(reason, 'cut') cut FROM (SELECT doc_id, source, CASE
  WHEN word IS NULL THEN 'no word'
  WHEN last_char = '�' THEN 'cut: broken character'
  WHEN line_n > coalesce(k3.goes_on, 0) THEN 'line of its own'
  WHEN last_line IS NOT NULL AND rlike(last_line, r'{block}') THEN IF(fragment AND NOT closed, 'cut: word', 'tag, item, file, sum or signature')
  WHEN stem AND (marked OR NOT closed) THEN 'cut: file name'
  WHEN closed THEN CASE WHEN k3.past >= {often} AND k3.stops <= {rarely} * k3.past THEN 'cut: run of 3' WHEN k1.past >= {often} AND k1.stops <= {rarely} * k1.past THEN 'cut: run of 1' WHEN open THEN 'cut: open' ELSE 'closed' END
  WHEN marked AND k3.trails >= {evidence} AND k3.trails > k3.goes_on THEN 'dots of the author'
  WHEN s5 < {closes} THEN 'cut: run of 5' WHEN s5 IS NULL AND s3 < {closes} THEN 'cut: run of 3' WHEN s5 IS NULL AND s3 IS NULL AND s2 < {closes} THEN 'cut: run of 2'
  WHEN fragment THEN 'cut: word'
  WHEN open THEN 'cut: open' WHEN at_limit THEN 'cut: limit' WHEN last_sign IN (',', ';', ':', '/', '+', '-', '&', '(') THEN 'cut: sign'
  WHEN coalesce(s5, s3, s2) >= {closes} THEN 'run ends'
  WHEN s1 >= {closes} THEN 'word ends'
  WHEN s1 < {closes} THEN 'cut: run of 1'
  ELSE 'cut: nothing like it' END reason
FROM (SELECT t.*, rlike(word, r'\d') AND rlike(word, r'^\p{L}') AND NOT contains(word, '.') stem, l.n line_n, m.top IS NOT NULL at_limit, f.fragment IS NOT NULL fragment, struct(k3.goes_on, k3.past, k3.stops, k3.trails) k3, struct(k1.past, k1.stops) k1,
             {s5} s5, {s3} s3, {s2} s2, {s1} s1
      FROM tokens t LEFT JOIN lines l USING (last_line) LEFT JOIN limits m ON t.source = m.source AND t.chars = m.top LEFT JOIN fragments f ON f.fragment = t.word
      LEFT JOIN counts k5 ON k5.key = keys[0] LEFT JOIN counts k3 ON k3.key = keys[1] LEFT JOIN counts k2 ON k2.key = keys[2] LEFT JOIN counts k1 ON k1.key = keys[3]))
"""


def _share(k: str) -> str:
    """Share of a run's occurrences that end a sentence, where there are enough of them."""
    return f"CASE WHEN {k}.goes_on + {k}.stops >= {{evidence}} THEN {k}.stops / ({k}.goes_on + {k}.stops) END"


def judge_truncation(documents: DataFrame) -> DataFrame:
    """(doc_id, source, reason, cut): whether each text ends inside a word or a sentence, with or without a mark for it, and by what.

    Counts run over all different texts, so copies of one are no evidence for it. A final tag line, list item, file name, sum, signature or line that many texts end
    in more often than its words go on is complete, and so are dots after a phrase that more often trails off than goes on,
    unless the last word is a fragment. A text without a closing sign whose length is the limit of its source's field was cut.
    Null and empty texts are not cut; repeated texts are each judged and listed; rows without a doc_id
    are left out; an empty table gives no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    names = []
    often, rarely = GOES_PAST
    values = {"block": _LAST_BLOCK, "often": often, "rarely": repr(rarely), "closes": repr(CLOSES), **{f"s{n}": _share(f"k{n}") for n in (5, 3, 2, 1)}, "evidence": EVIDENCE}

    def step(name: str, query: str, store: bool = False) -> DataFrame:
        for key, value in values.items():
            query = query.replace("{" + key + "}", str(value))
        out = spark.sql(query)
        out = materialise(out, name) if store else out
        out.createOrReplaceTempView(name)
        names.append(name)
        return out

    def few(name: str, rows: DataFrame) -> None:
        """A view of a stored table, to be broadcast where it is counted to be small."""
        (F.broadcast(rows) if rows.count() <= BROADCAST_KEYS else rows).createOrReplaceTempView(name)
        names.append(name)

    docs.createOrReplaceTempView("docs")
    step("bodies", _BODIES)
    split = step("tokens", f"SELECT *, monotonically_increasing_id() row_id FROM ({_TOKENS})", store=True)
    few("copies", materialise(spark.sql(_COPIES), "copies"))
    step("texts", _TEXTS)
    tokens = materialise(spark.sql(f"SELECT *, concat(runs, array(xxhash64(1, word))) keys FROM ({_FINALS})"), "finals")
    few("wanted", materialise(tokens.select(F.explode("keys").alias("key")).distinct(), "wanted"))
    step("positions", _POSITIONS)
    step("counts", _COUNTS, store=True)
    texts = spark.sql(_TEXTS)
    tokens.createOrReplaceTempView("tokens")
    texts.createOrReplaceTempView("texts")
    step("fragments", _FRAGMENTS, store=True)
    step("lines", _LINES, store=True)
    step("limits", _LIMITS, store=True)
    out = step("verdict", _VERDICT)
    for name in [*names, "docs"]:
        spark.catalog.dropTempView(name)
    return out


def cut_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of the texts that were cut."""
    return judge_truncation(documents).where("cut").select("doc_id")


def truncation_by_source(documents: DataFrame) -> DataFrame:
    """(source, n_documents, n_cut, share_cut): how often each source cuts its texts; a null source is a source too."""
    out = judge_truncation(documents).groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if("cut").alias("n_cut"))
    return out.withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_documents"), 6))
