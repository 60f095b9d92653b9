"""SQL fragments shared by the statements that check the queries."""

from __future__ import annotations

from ..constants import DEFAULT_DELIMITER
from .fixtures import TASKS as TASK_FILE

# The form of SPLIT_PATTERN that DuckDB can run: RE2 has neither possessive quantifiers nor lookahead. This form splits the given
# tables alike; it is not equivalent in general.
RE2_SPLIT = (
    r"''(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,2}"
    r"| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]|\s+"
)


def pieces(text: str) -> str:
    return f"regexp_extract_all({text}, '{RE2_SPLIT}')"


def byte_id(b: str) -> str:
    """Id of a byte: 9 special tokens, then printable bytes, then the rest."""
    return (
        f"CASE WHEN {b} BETWEEN 33 AND 126 THEN {b} - 24 WHEN {b} BETWEEN 161 AND 172 THEN {b} - 58 "
        f"WHEN {b} >= 174 THEN {b} - 59 WHEN {b} <= 32 THEN {b} + 197 WHEN {b} <= 160 THEN {b} + 103 ELSE 264 END"
    )


def byte_ids(text: str) -> str:
    """Byte ids of a text as a list."""
    value = "('0x' || x)::INT"
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: {byte_id(value)})"


def hash32(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


SPLIT = "SELECT max(source) AS last_shard FROM documents"

# documents as token lists: BOS, then the bytes of the text
DOC_IDS = f"""
doc_ids AS (
  SELECT doc_id, source AS shard, lang, [0] || {byte_ids("text")} AS ids FROM documents
)"""

TOKENS = DOC_IDS + """,
tokens AS (
  SELECT doc_id, shard, lang, unnest(ids) AS token_id, generate_subscripts(ids, 1) AS pos FROM doc_ids
)"""

RANKED = """
ranked AS (
  SELECT *, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8) AS row_group
  FROM documents
),
dealt AS (SELECT *, row_group % 3 AS rank FROM ranked)"""


def draws(k: int, seed: int, source: str) -> str:
    """k distinct others of every row of ``source(task, idx)``, one column per draw."""
    picks, cols = [], []
    for i in range(k):
        top = f"(n - 1 - {k - i})"
        drawn = f"({hash32(f'(idx + {seed}) || {chr(39)}:{i}{chr(39)}')} % ({top} + 1))"
        taken = ", ".join(f"p{j}" for j in range(i))
        cols.append(f"{drawn} AS t{i}, {top} AS j{i}")
        picks.append(f"CASE WHEN t{i} IN ({taken}) THEN j{i} ELSE t{i} END AS p{i}" if i else "t0 AS p0")
    steps = f"SELECT *, {', '.join(cols)} FROM (SELECT *, count(*) OVER (PARTITION BY task) AS n FROM {source})"
    for pick in picks:
        steps = f"SELECT *, {pick} FROM ({steps})"
    rows = " UNION ALL ".join(
        f"SELECT task, idx, {i} AS draw, p{i} + (CASE WHEN p{i} >= idx THEN 1 ELSE 0 END) AS other_idx FROM base"
        for i in range(k)
    )
    return f"WITH base AS ({steps}) {rows}"


def task_draws(seed: int) -> str:
    """Draws of as many others as each task has examples."""
    return " UNION ALL ".join(
        f"SELECT * FROM ({draws(k, seed, f'(SELECT * FROM items WHERE task = {chr(39)}{task}{chr(39)})')})" for task, (_, k, _) in TASK_FILE.items() if k
    )


def _text(value: str) -> str:
    return " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in value)


TASKS = f"""
tasks AS (
  SELECT * FROM (VALUES {", ".join(f"('{t}', '{kind}', {k}, {_text(d or DEFAULT_DELIMITER)})" for t, (kind, k, d) in TASK_FILE.items())})
    AS t(task, task_type, num_fewshot, delimiter)
  WHERE task IN (SELECT 'task' || (item_id % 4) FROM benchmark)
)"""

ITEMS = TASKS + f""",
words AS (SELECT item_id, 'task' || (item_id % 4) AS task, string_split(text, ' ') AS w FROM benchmark),
halves AS (
  SELECT item_id, task, array_to_string(w[1:len(w) // 2], ' ') AS head,
         array_to_string(w[len(w) // 2 + 1:], ' ') AS tail
  FROM words
),
shuffled AS (
  SELECT *, row_number() OVER (PARTITION BY task ORDER BY md5('1337:' || item_id), item_id) - 1 AS idx FROM halves
),
wrong_draws AS ({draws(3, 99, "shuffled")}),
wrong AS (
  SELECT d.task, d.idx, list(o.head ORDER BY d.draw) AS heads, list(o.tail ORDER BY d.draw) AS tails
  FROM wrong_draws d JOIN shuffled o ON o.task = d.task AND o.idx = d.other_idx GROUP BY d.task, d.idx
),
placed AS (
  SELECT s.*, w.heads, w.tails, {hash32("'7:' || s.item_id")} % 4 AS g FROM shuffled s JOIN wrong w USING (task, idx)
),
items AS (
  SELECT task, idx, item_id, head, tail, g,
         task_type, delimiter AS delim,
         tails[1:g] || [tail] || tails[g + 1:] AS choices,
         heads[1:g] || [head] || heads[g + 1:] AS options
  FROM placed JOIN tasks USING (task)
),
shot_draws AS ({task_draws(1234)}),
shots AS (
  SELECT d.task, d.idx, d.draw, o.item_id,
         CASE o.task_type WHEN 'multiple_choice' THEN o.head || o.delim || o.choices[o.g + 1]
              WHEN 'schema' THEN o.options[o.g + 1] || o.delim || o.tail
              ELSE trim(o.head) || o.delim || o.tail END || chr(10) || chr(10) AS solved
  FROM shot_draws d JOIN items o ON o.task = d.task AND o.idx = d.other_idx
),
heads AS (
  SELECT i.task, i.idx, coalesce(string_agg(solved, '' ORDER BY draw), '') AS lead
  FROM items i LEFT JOIN shots s ON s.task = i.task AND s.idx = i.idx GROUP BY i.task, i.idx
),
prompts AS (
  SELECT i.*, lead,
    CASE task_type WHEN 'multiple_choice' THEN list_transform(choices, lambda c: lead || head || delim || c)
      WHEN 'schema' THEN list_transform(options, lambda o: lead || o || delim || tail)
      ELSE [regexp_replace(lead || head || delim, '^\\s+|\\s+$', '', 'g'), lead || head || delim || tail] END AS prompts
  FROM items i JOIN heads USING (task, idx)
)"""

OPTIONS = ITEMS + f""",
opts AS (
  SELECT task, idx, item_id, task_type, g, option - 1 AS option, [0] || {byte_ids("prompt")} AS seq
  FROM (SELECT *, unnest(prompts) AS prompt, generate_subscripts(prompts, 1) AS option FROM prompts)
),
paired AS (
  SELECT o.*, f.seq AS first_seq FROM opts o JOIN opts f ON f.task = o.task AND f.idx = o.idx AND f.option = 0
),
shared AS (
  SELECT *,
    list_position(list_transform(range(1, greatest(len(seq), len(first_seq)) + 2),
      lambda i: coalesce(seq[i] = first_seq[i], false)), false) - 1 AS pre,
    list_position(list_transform(range(1, greatest(len(seq), len(first_seq)) + 2),
      lambda i: coalesce(list_reverse(seq)[i] = list_reverse(first_seq)[i], false)), false) - 1 AS suf
  FROM paired
),
common AS (SELECT *, min(pre) OVER w AS cpre, min(suf) OVER w AS csuf,
                  min(CASE WHEN option = 0 THEN len(seq) END) OVER w AS first_len
           FROM shared WINDOW w AS (PARTITION BY task, idx)),
spans AS (
  SELECT task, idx, item_id, task_type, g, CASE WHEN task_type = 'language_modeling' THEN 0 ELSE option END AS option, seq,
    CASE task_type WHEN 'multiple_choice' THEN cpre WHEN 'schema' THEN len(seq) - csuf ELSE first_len END AS start_at,
    len(seq) AS end_at
  FROM common WHERE task_type <> 'language_modeling' OR option = 1
)"""

BIGRAMS = TOKENS + """,
train_pairs AS (
  SELECT token_id AS prev_id, lead(token_id) OVER (PARTITION BY doc_id ORDER BY pos) AS target_id
  FROM tokens WHERE shard <> (SELECT max(source) FROM documents)
),
bigrams AS (SELECT prev_id, target_id, count(*) AS n FROM train_pairs WHERE target_id IS NOT NULL GROUP BY ALL),
prevs AS (
  SELECT prev_id, sum(n) AS total, first(target_id ORDER BY n DESC, target_id) AS pred_id FROM bigrams GROUP BY prev_id
)"""

SCORES = OPTIONS + "," + BIGRAMS + """,
steps AS (
  SELECT task, idx, item_id, task_type, g, option, seq, unnest(range(start_at - 1, end_at - 1)) AS pos FROM spans
),
scores AS (
  SELECT s.task, s.idx, s.item_id, s.task_type, s.g, s.option, s.pos,
         s.seq[s.pos + 1] AS prev_id, s.seq[s.pos + 2] AS target_id, coalesce(p.pred_id, 0) AS pred_id,
         -ln((coalesce(b.n, 0) + 1) / (coalesce(p.total, 0) + 265)) AS nats
  FROM steps s
  LEFT JOIN bigrams b ON b.prev_id = s.seq[s.pos + 1] AND b.target_id = s.seq[s.pos + 2]
  LEFT JOIN prevs p ON p.prev_id = s.seq[s.pos + 1]
)"""

DECISIONS = SCORES + """,
losses AS (SELECT task, idx, task_type, g, option, sum(nats::DECIMAL(20, 12))::DOUBLE / count(nats) AS mean_loss, bool_and(pred_id = target_id) AS match
           FROM scores GROUP BY ALL),
decisions AS (
  SELECT task, idx,
    CASE WHEN any_value(task_type) = 'language_modeling' THEN bool_and(match)
         ELSE first(option ORDER BY mean_loss NULLS LAST, option) = any_value(g) END AS correct
  FROM losses GROUP BY task, idx
)"""


def symbols(token: str) -> str:
    """A word as text of five characters per symbol, ``|`` and the id in four digits, so that a
    merge is a text replacement."""
    symbol = f"'|' || lpad(({byte_id(chr(40) + chr(39) + '0x' + chr(39) + ' || x)::INT')})::VARCHAR, 4, '0')"
    return f"array_to_string(list_transform(regexp_extract_all(hex(encode({token})), '..'), lambda x: {symbol}), '')"


def bpe(n_merges: int, source: str, others: str | None = None) -> str:
    """CTEs that learn merges one at a time, to follow WITH RECURSIVE: ``merges(i, left_id, right_id)`` from 1 on, and
    ``learned(token, s)``, the distinct words after all merges. ``others`` selects the texts of further words, which do not
    count in training but are merged with the others."""
    more = f" UNION ALL SELECT unnest({pieces('text')}), 0 FROM {others}" if others else ""
    return f"""pre AS MATERIALIZED (SELECT unnest({pieces('text')}) AS token, 1 AS n FROM {source}{more}),
steps(i, pair, token, n, s) AS (
  SELECT 0, NULL::VARCHAR, token, n, {symbols("token")} FROM (SELECT token, sum(n) AS n FROM pre GROUP BY token)
  UNION ALL
  SELECT i + 1, b.pair, token, n, replace(s, b.pair, '|' || lpad((265 + i)::VARCHAR, 4, '0')) FROM steps, (
    SELECT pair FROM (SELECT n, substr(s, 5 * unnest(range(0, len(s) // 5 - 1)) + 1, 10) AS pair FROM steps WHERE n > 0)
    GROUP BY pair ORDER BY sum(n) DESC, pair LIMIT 1) b
  WHERE i < {n_merges}
),
merges AS MATERIALIZED (SELECT DISTINCT i, substr(pair, 2, 4)::INT AS left_id, substr(pair, 7, 4)::INT AS right_id FROM steps WHERE i > 0),
learned AS (SELECT token, s FROM steps WHERE i = {n_merges})"""


TOKEN_HEX = """bytes AS (SELECT b, {byte_id} AS token_id FROM range(256) t(b)),
spelled(i, h) AS (
  SELECT 0, list(lpad(upper(to_hex(b)), 2, '0') ORDER BY token_id) FROM bytes
  UNION ALL SELECT p.i + 1, p.h || [p.h[m.left_id - 8] || p.h[m.right_id - 8]] FROM spelled p JOIN merges m ON m.i = p.i + 1
),
tokens AS (SELECT (k + 8)::INT AS token_id, h[k] AS h FROM (SELECT h FROM spelled ORDER BY i DESC LIMIT 1), range(1, 257 + {n_merges}) t(k))"""


def token_hex(n_merges: int) -> str:
    """CTEs after ``bpe``: ``tokens(token_id, h)``, the bytes of every plain token in hexadecimal."""
    return TOKEN_HEX.format(byte_id=byte_id("b"), n_merges=n_merges)
