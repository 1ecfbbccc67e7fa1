"""DuckDB twins of the text queries that SQL can express on whole tables."""

from __future__ import annotations

from levelbook.llm.licenses import oracle as licence_oracle
from levelbook.llm.quality import ABUSIVE, BASE_RULES, CURRENT, POLICIES, mask_of

_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _count(characters: str) -> str:
    return f"length(regexp_replace(text, '[^{characters}]', '', 'g'))"


_FORMS = ", ".join(f"'{word}{end}'" for word in ABUSIVE for end in ("", ".", ",", "!", "?"))
# The rules of levelbook.llm.quality in their order, as conditions in SQL.
_CONDITIONS = (
    "n_words < 50", "100 * n_repeat_words > 50 * n_words", "10 * n_symbols > n_words",
    "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines", "n_letters >= 20 AND 2 * n_capitals > n_letters",
    "10 * n_exclamations > 3 * n_words", "word_chars < 2 * n_words OR word_chars > 20 * n_words", "n_abusive >= 2",
)
_BITS = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(_CONDITIONS))

QUALITY = f"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
    SELECT r, doc_id, text, regexp_extract_all(text, {_WORD}) AS words,
           list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, {_WORD})) AS lines
    FROM texts),
windows AS (
    SELECT r, unnest(range(1, len(words) - 1)) AS pos, words FROM split WHERE len(words) >= 3),
repeated AS (
    SELECT r, pos FROM windows
    QUALIFY count(*) OVER (PARTITION BY r, words[pos], words[pos + 1], words[pos + 2]) > 1),
covered AS (
    SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([pos, pos + 1, pos + 2]) AS p FROM repeated) GROUP BY r),
measured AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
           CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
           {_count("#*$%&|<>")} AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
           {_count("A-Za-z")} AS n_letters, {_count("A-Z")} AS n_capitals, {_count("!")} AS n_exclamations,
           CAST(len(list_intersect(list_distinct(list_transform(words, lambda w: {_LOWER.format("w")})), [{_FORMS}])) AS BIGINT)
               AS n_abusive
    FROM split LEFT JOIN covered USING (r)),
failed AS (SELECT *, CAST({_BITS} AS BIGINT) AS failures FROM measured)
SELECT *, failures & {mask_of(BASE_RULES)} <> 0 AS base_failed,
       failures & {CURRENT.mask} = 0 AS kept, failures & {POLICIES["v1"].mask} = 0 AS kept_v1
FROM failed"""

PHRASES = f"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS words FROM documents),
windows AS (
    SELECT doc_id, pos, md5(array_to_string(list_slice(words, pos, pos + 49), ' ')) AS h
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM split WHERE len(words) >= 50)),
later AS (SELECT doc_id, pos FROM windows QUALIFY doc_id > min(doc_id) OVER (PARTITION BY h)),
removed AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS p FROM later),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text
    FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM split)
    ANTI JOIN removed USING (doc_id, p) GROUP BY doc_id)
SELECT split.doc_id, CAST(len(words) AS BIGINT) AS n_words,
       coalesce((SELECT count(*) FROM removed WHERE removed.doc_id = split.doc_id), 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORD}) AS words FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, hash(list_slice(words, pos, pos + 4)) AS s
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS pos FROM split WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, ' ' ORDER BY s)) AS key FROM shingles GROUP BY doc_id),
pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * common >= 75 * (p.n + q.n - common)),
reached AS (
    SELECT doc_id AS node, doc_id AS other FROM sizes
    UNION SELECT node, b FROM reached JOIN links ON other = a)
SELECT split.doc_id, coalesce(n, 0) AS n_shingles,
       coalesce(min(split.doc_id) OVER (PARTITION BY key, CASE WHEN key IS NULL THEN split.doc_id END), split.doc_id) AS class_id,
       coalesce(component, split.doc_id) AS component_id
FROM split LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT node, min(other) AS component FROM reached GROUP BY node) ON node = split.doc_id"""

NEGATIVES = """
WITH whole AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scores AS (
    SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same,
           CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM whole a JOIN whole b ON a.id % 50 = 0 AND a.id <> b.id),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES = f"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
    SELECT r, doc_id, pos, lines[pos] AS line, {_LOWER.format(f"trim(lines[pos], {_BLANK})")} AS key
    FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM split)),
repeated AS (
    SELECT key, max(doc_id) AS owner FROM lines WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
    SELECT lines.*, owner IS NOT NULL AND doc_id IS DISTINCT FROM owner AS goes FROM lines LEFT JOIN repeated USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM marked GROUP BY r"""

ORACLES: dict[str, str] = {
    "op3_ngram_jaccard_join": JACCARD,
    "op8_quality_rules": QUALITY,
    "op9_substring_dedup": PHRASES,
    "op10_license_scan": licence_oracle(),
    "op11_hard_negatives": NEGATIVES,
    "op12_line_dedup": LINES,
}
