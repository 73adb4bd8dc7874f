"""Problem 2: mapping freely entered values to a canonical list, in SQL only.

Partition-based pigeonhole join: a reference string of length L that may differ in k
characters is cut into k+1 segments; a value within k edits must hold one of the segments
unchanged, at most k places from where the reference has it. Values' substrings are joined
to segments by equality, positions are compared, and the surviving pairs are verified with
the built-in ``levenshtein``. What no pair survives for is reported through an anti-join.

Before that, values are brought to plain letters: wrong decodings are undone, look-alike
letters and accents folded, invisible characters dropped, and numbering, brackets, quotes
and remarks around the name removed. Words may come rotated, joined, or cut off with a full
stop; a cut-off word is compared with as much of the reference word as it has.

Defined results
---------------
* One row per row and field with a value that is neither null nor blank; nulls and blanks
  in either field have no row. Repeated rows are mapped each.
* ``entry_id`` is -1 where no reference name is within its limit, and where two different
  names are equally near.
* A subcategory name listed under several categories takes the category the same row was
  mapped to, and is -1 without one (or if the name is not listed under it).
* Very long values are compared whole; past the longest reference name plus its limit they
  cannot match. Empty tables give an empty result; an empty list maps all to -1.

The join runs on *distinct* values with their counts, so a value that fills a third of the
rows is matched once, and mapped back over salted keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docloom.runtime import table, written

#: Edits a name of that length may differ in, as SQL over ``len``.
LIMIT_SQL = "CASE WHEN len <= 4 THEN 0 WHEN len <= 7 THEN 1 WHEN len <= 10 THEN 2 ELSE cast(floor(len * 0.28) AS int) END"
#: Edits the segments must allow for: more, as two swapped letters count as one difference but are two edits.
EDITS_SQL = "CASE WHEN len <= 4 THEN 0 WHEN len <= 10 THEN accepted + 1 ELSE accepted END"
SALTS = 8

#: Cyrillic and Greek letters that look Latin, then accented letters.
_ALIKE = ("авекмнорстухісјԁԛԝһѕ" "ο" "ν" "ąćęłńóśźżáàâäãåéèêëíìîïòôöõúùûüýčďěňřšťůžß",
          "abekmhopctyxicjdqwhs" "o" "v" "acelnoszzaaaaaaeeeeiiiioooouuuuycdenrstuzs")


#: Character references, by name or number, of Polish letters and the ampersand.
_ENTITIES = (("(?i)&([a-z])(?:acute|grave|uml|circ|cedil|caron|tilde);", "$1"), ("&#(?:260|261);", "a"), ("&#(?:262|263);", "c"), ("&#(?:280|281);", "e"),
             ("&#(?:321|322);", "l"), ("&#(?:323|324);", "n"), ("&#(?:211|243);", "o"), ("&#(?:346|347);", "s"), ("&#(?:377|378|379|380);", "z"),
             ("&(?:amp|nbsp|#160|#38);", " "))


def plain_sql(x: str) -> str:
    """SQL for a value in plain lower-case letters, before any part of it is removed."""
    undone = f"cast(encode({x}, 'ISO-8859-1') AS string)"
    decoded = (f"CASE WHEN {x} rlike '^[\\\\x{{0}}-\\\\x{{FF}}]*$' AND {x} rlike '[\\\\x{{C2}}-\\\\x{{C5}}][\\\\x{{80}}-\\\\x{{BF}}]' "
               f"THEN coalesce(try_validate_utf8({undone}), {x}) ELSE {x} END")
    visible = f"regexp_replace({decoded}, '[\\\\p{{M}}\\\\p{{Cf}}]', '')"
    for entity, letter in _ENTITIES:
        visible = f"regexp_replace({visible}, '{entity}', '{letter}')"
    folded = f"translate(lower({visible}), '{_ALIKE[0]}', '{_ALIKE[1]}')"
    return f"trim(regexp_replace({folded}, '(?U)[\\\\s\\\\x{{1C}}-\\\\x{{1F}}]+', ' '))"


#: What may stand around a name: numbering before it, remarks and numbers after it.
_BEFORE = r"^(?:kat\\.? *\\d+ *[:.)-] *|[a-z]{1,3}-\\d+ */ *|\\d+ *[.):] *|\\d+ +- +|[*#•-]+ *)"
_AFTER = r"(?: +- +\\p{L}+| +wg +\\p{L}+| */ *\\d+| *\\([^()]*\\)| +nr *\\d+|[ ?!;:,*]+)$"


def words_sql(x: str) -> str:
    """SQL for the words of a plain value; a final full stop marks a word as cut off."""
    bare = f"regexp_replace({x}, '[\"„”“«»\\\\[\\\\]{{}}*]', '')"
    bare = f"regexp_replace(trim({bare}), '{_BEFORE}', '')"
    for _ in range(2):
        bare = f"regexp_replace({bare}, '{_AFTER}', '')"
    spaced = f"regexp_replace({bare}, '[-_/,;:&]|[.](?=[a-z])', ' ')"
    letters = f"regexp_replace({spaced}, '[^a-z. ]', '')"
    return f"filter(split({letters}, ' '), w -> w rlike '[a-z]')"


#: Inflectional endings of Polish nouns and adjectives, in plain letters.
_ENDING = "(?:i?ach|i?om|i?ami|i?ego|i?emu|ych|ymi|im|ym|em|ow|i?[aeouy]|i)$"


def _stems(words: str) -> str:
    return f"array_join(transform({words}, w -> regexp_replace(replace(w, '.', ''), '{_ENDING}', '')), '')"


def _segments_sql(source: str) -> str:
    """k+1 segments of each name, the longer ones last."""
    return f"""
    SELECT name, len, k, i, cast(i * div(len, k + 1) AS int) AS start,
           substring(name, cast(i * div(len, k + 1) AS int) + 1, cast(CASE WHEN i = k THEN len - i * div(len, k + 1) ELSE div(len, k + 1) END AS int)) AS part
    FROM (SELECT *, explode(sequence(0, k)) AS i FROM {source})""".replace("div(len, k + 1)", "(len div (k + 1))")


#: Distinct values with their words: written once, as every later step starts from them.
WORDED = f"""
WITH entered AS (
    SELECT 'category' AS field, category AS value FROM <answers> UNION ALL SELECT 'subcategory', subcategory FROM <answers>),
distinct_values AS (
    SELECT field, value FROM entered WHERE value rlike '(?U)[^\\\\s]' GROUP BY field, value)
SELECT field, value, {words_sql("plain")} AS words FROM (SELECT field, value, {plain_sql("value")} AS plain FROM distinct_values)
"""

#: The list's names with their words, and with their lengths and limits: small, and written once as well.
NAMED = f"""
WITH listed AS (
    SELECT entry_id, category, subcategory IS NULL AS is_category, explode(array_append(coalesce(aliases, array()), coalesce(subcategory, category))) AS label
    FROM <taxonomy> WHERE entry_id IS NOT NULL)
SELECT entry_id, category, CASE WHEN is_category THEN 'category' ELSE 'subcategory' END AS field,
       transform({words_sql(plain_sql("label"))}, w -> replace(w, '.', '')) AS words
FROM listed"""

SIZED = f"""
WITH names AS (
    SELECT field, array_join(words, '') AS name, min(words) AS words, count(DISTINCT entry_id) AS entries, min(entry_id) AS entry_id
    FROM <named> WHERE size(words) > 0 GROUP BY field, array_join(words, ''))
SELECT *, {EDITS_SQL} AS k FROM (SELECT *, {LIMIT_SQL} AS accepted FROM (SELECT *, length(name) AS len FROM names))"""

QUERY_PARTS = f"""
WITH sized AS (SELECT * FROM <sized>),
longest AS (SELECT coalesce(max(len + k), 0) AS most FROM sized),
segments AS (SELECT DISTINCT field, s.name, s.k, s.start, s.part FROM ({_segments_sql("sized")}) s JOIN sized USING (name)),
worded AS (SELECT * FROM <worded>),
turned AS (
    SELECT field, value, r, concat(slice(words, r + 1, size(words)), slice(words, 1, r)) AS words
    FROM (SELECT /*+ REPARTITION(<parts>) */ *, explode(sequence(0, size(words) - 1)) AS r FROM worded
          WHERE size(words) > 0 AND length(replace(array_join(words, ''), '.', '')) <= (SELECT most FROM longest))),
short_forms AS (SELECT /*+ REPARTITION(<parts>) */ field, value, words, replace(array_join(words, ''), '.', '') AS form FROM turned),
widths AS (SELECT collect_set(length(part)) AS all_widths FROM segments),
parts AS (
    SELECT field, value, words, form, p AS place, substring(form, p + 1, width) AS part
    FROM (SELECT *, explode(sequence(0, length(form) - width)) AS p
          FROM (SELECT *, explode((SELECT all_widths FROM widths)) AS width FROM short_forms) WHERE length(form) >= width)),
candidates AS (
    SELECT DISTINCT a.field, a.value, a.words, a.form, b.name
    FROM parts a JOIN segments b ON a.part = b.part AND a.field = b.field WHERE abs(a.place - b.start) <= b.k),
verified AS (
    SELECT c.field, c.value, c.name, s.entries, s.entry_id, s.accepted,
           least(levenshtein(c.form, c.name),
                 CASE WHEN length(c.form) = s.len AND array_sort(split(c.form, '')) = array_sort(split(c.name, '')) THEN (levenshtein(c.form, c.name) + 1) div 2 END,
                 CASE WHEN size(c.words) = size(s.words) AND s.len > 7 THEN levenshtein({_stems("c.words")}, {_stems("s.words")}) + 1 END,
                 CASE WHEN size(c.words) = size(s.words) AND exists(c.words, w -> w like '%.') AND length(c.form) >= 4 THEN aggregate(
                     zip_with(c.words, s.words, (w, n) -> CASE WHEN w like '%.' AND length(w) > 3 THEN levenshtein(replace(w, '.', ''), left(n, length(w) - 1))
                                                               ELSE levenshtein(replace(w, '.', ''), n) END), 0, (x, y) -> x + y) END) AS d
    FROM candidates c JOIN sized s ON c.name = s.name AND c.field = s.field),
nearest AS (
    SELECT field, value, name, entries, entry_id, d, min(d) OVER (PARTITION BY field, value) AS best
    FROM (SELECT field, value, name, entries, entry_id, min(d) AS d FROM verified WHERE d <= accepted GROUP BY field, value, name, entries, entry_id)),
mapped AS (
    SELECT field, value, min(name) AS name, min(entries) AS entries, min(entry_id) AS entry_id
    FROM nearest WHERE d = best GROUP BY field, value HAVING count(*) = 1),
unmatched AS (
    SELECT field, value, cast(NULL AS string) AS name, 0L AS entries, -1 AS entry_id
    FROM worded v LEFT ANTI JOIN mapped m ON v.field = m.field AND v.value = m.value),
"""  # the parts below read it
MAPPING = QUERY_PARTS.rstrip().rstrip(",") + """
SELECT * FROM mapped UNION ALL SELECT * FROM unmatched"""

ROWS = f"""
WITH mapping AS (SELECT *, explode(sequence(0, {SALTS - 1})) AS salt FROM <mapping>),
first_field AS (
    SELECT a.*, coalesce(m.entry_id, -1) AS category_entry
    FROM (SELECT *, pmod(coalesce(answer_id, 0), {SALTS}) AS salt FROM <answers>) a
    LEFT JOIN mapping m ON m.field = 'category' AND a.category = m.value AND a.salt = m.salt),
second_field AS (
    SELECT a.answer_id, a.category, a.subcategory, a.category_entry, m.name, m.entries, m.entry_id AS subcategory_entry, t.category AS category_name
    FROM first_field a
    LEFT JOIN mapping m ON m.field = 'subcategory' AND a.subcategory = m.value AND a.salt = m.salt
    LEFT JOIN <taxonomy> t ON a.category_entry = t.entry_id),
several AS (SELECT DISTINCT category, array_join(words, '') AS name, entry_id FROM <named> WHERE field = 'subcategory')
SELECT answer_id, 'category' AS field, category_entry AS entry_id FROM second_field WHERE category rlike '(?U)[^\\\\s]'
UNION ALL
SELECT s.answer_id, 'subcategory', CASE WHEN s.entries > 1 THEN coalesce(u.entry_id, -1) ELSE coalesce(s.subcategory_entry, -1) END
FROM second_field s LEFT JOIN several u ON s.entries > 1 AND s.name = u.name AND s.category_name = u.category
WHERE s.subcategory rlike '(?U)[^\\\\s]'
"""


def mapped(answers: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``(answer_id, field, entry_id)`` for each value entered."""
    views = {}
    for name, df in (("answers", answers.select("answer_id", "category", "subcategory")),
                     ("taxonomy", taxonomy.select("entry_id", "category", "subcategory", "aliases"))):
        views[name] = f"docloom_{name}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(views[name])

    def run(query: str) -> DataFrame:
        for name, view in views.items():
            query = query.replace(f"<{name}>", view)
        return answers.sparkSession.sql(query)

    parts = 2 * answers.sparkSession.sparkContext.defaultParallelism
    for name, query in (("named", NAMED), ("sized", SIZED), ("worded", WORDED), ("mapping", MAPPING)):
        view = f"docloom_{name}_{uuid.uuid4().hex}"
        written(run(query.replace("<parts>", str(parts)))).createOrReplaceTempView(view)
        views[name] = view
    return run(ROWS)


def found(spark: SparkSession, d: str) -> DataFrame:
    return mapped(table(spark, d, "structured_output"), table(spark, d, "taxonomy"))


def unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that fit no entry, with how often they were entered."""
    answers = table(spark, d, "structured_output")
    rows = found(spark, d).where("entry_id = -1").join(answers.select("answer_id", "category", "subcategory"), "answer_id")
    return rows.selectExpr("field", "CASE WHEN field = 'category' THEN category ELSE subcategory END AS value").groupBy("field", "value").count().withColumnRenamed("count", "n")


QUERIES = {"p2_found": found, "p2_unmatched": unmatched}
