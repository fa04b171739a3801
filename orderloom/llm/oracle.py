"""DuckDB SQL of the queries that SQL can express, written another way than the operators."""

from __future__ import annotations

from orderloom.llm import secrets

SEED = 17


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def shards(n_shards: int) -> str:
    # The CRC-32 of a text, byte by byte with the table of its polynomial.
    return f"""
    WITH RECURSIVE steps AS (
      SELECT range AS n, 0 AS k, range::BIGINT AS c FROM range(256)
      UNION ALL
      SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM steps WHERE k < 8
    ),
    crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
    hexed AS (
      SELECT doc_id, coalesce('=' || source, '') AS s, strlen(coalesce(text, '')) AS n_bytes, hex(encode(coalesce(text, ''))) AS h
      FROM documents
    ),
    bytes AS (
      SELECT *, list_transform(range(n_bytes), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM hexed
    ),
    summed AS (
      SELECT doc_id, s, (n_bytes + 1)::BIGINT AS size,
        xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS crc
      FROM bytes, crc
    ),
    shuffled AS (
      SELECT *, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '-') || '|' || crc || '|' || size) AS digest FROM summed
    ),
    ranked AS (
      SELECT *, (row_number() OVER (PARTITION BY s ORDER BY digest, doc_id NULLS FIRST, crc, size) - 1
          + (('0x' || substr(md5('{SEED}|' || s), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)
        / count(*) OVER (PARTITION BY s) AS fraction
      FROM shuffled
    ),
    placed AS (
      SELECT *, row_number() OVER (ORDER BY fraction, s, digest, doc_id NULLS FIRST, crc, size) - 1 AS position, count(*) OVER () AS n
      FROM ranked
    )
    SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (position * {n_shards} // n)::INT AS shard,
      position - ((position * {n_shards} // n) * n + {n_shards - 1}) // {n_shards} AS slot, NULL::INT AS grown_shard
    FROM placed
    """


def found_secrets() -> str:
    kinds = secrets.KINDS
    base = "\n      UNION ALL\n".join(
        f"      SELECT rid, doc_id, t, {number} AS kind, string_split_regex(t, {_quoted(pattern)}) AS gaps,"
        f" regexp_extract_all(t, {_quoted(pattern)}) AS hits FROM texts"
        for number, pattern in enumerate([*secrets.BASE.values(), "[A-Za-z0-9+/_-]{20,}={0,2}"])
    )
    weights = ", ".join(f"{secrets.weight(n)}::BIGINT" for n in range(secrets.WINDOW + 1))
    allowed = " OR ".join(f"regexp_matches(found, {_quoted(p)})" for p in secrets.ALLOWED)
    is_hex = f"regexp_matches(found, {_quoted(secrets.HEX_CLASS)})"
    names = ", ".join(f"'{k}'" for k in kinds)
    counts = ", ".join(f"count(*) FILTER (kind = {i})::BIGINT AS n_{name}" for i, name in enumerate(secrets.BASE))
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    cut AS (
{base}
    ),
    matches AS (
      SELECT rid, kind, hits[i] AS found,
        (coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)
          + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::BIGINT AS start
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM cut)
    ),
    base AS (
      SELECT rid, kind, start, start + length(found) AS stop FROM matches
      WHERE kind < 3 AND (kind <> 0 OR length(regexp_extract(found, {_quoted(secrets.ASSIGN)}, 2)) >= {secrets.ASSIGN_VALUE})
    ),
    candidates AS (
      SELECT rid, start, found, {is_hex} AS is_hex FROM matches
      WHERE kind = 3 AND regexp_matches(found, '[0-9]') AND NOT ({allowed})
    ),
    windows AS (
      SELECT *, string_split(substr(found, place + 1, {secrets.WINDOW}), '') AS symbols
      FROM (SELECT *, unnest(range(length(found) - {secrets.WINDOW - 1})) AS place FROM candidates)
    ),
    weighed AS (
      SELECT rid, start, found, is_hex, place,
        list_sum(list_transform(list_distinct(symbols), lambda c: ([{weights}])[len(list_filter(symbols, lambda x: x = c)) + 1])) AS total
      FROM windows
    ),
    added AS (
      SELECT rid, CASE WHEN is_hex THEN 3 ELSE 4 END AS kind, start + min(place) AS start, start + max(place) + {secrets.WINDOW} AS stop
      FROM weighed
      WHERE total <= CASE WHEN is_hex THEN {secrets.most_weight(secrets.LIMITS["entropy_hex"])}
        ELSE {secrets.most_weight(secrets.LIMITS["entropy_mixed"])} END
      GROUP BY rid, start, found, is_hex
    ),
    every AS (
      SELECT rid, kind, start, stop FROM base
      UNION ALL
      SELECT a.rid, a.kind, a.start, a.stop FROM added a
      WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = a.rid AND b.start <= a.start AND a.stop <= b.stop)
    ),
    written AS (SELECT rid, kind, start, ([{names}])[kind + 1] || ':' || start || ':' || stop AS w FROM every),
    summed AS (
      SELECT rid, {counts},
        string_agg(w, ',' ORDER BY start, kind) FILTER (kind < 3) AS base_text, string_agg(w, ',' ORDER BY start, kind) AS spans
      FROM written GROUP BY rid
    )
    SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in secrets.BASE)},
      sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM texts LEFT JOIN summed USING (rid)
    """


TOP_K = """
    WITH vectors AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    ),
    placed AS (
      SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5
"""


STOP_WORDS = (
    "the of and to in is that it for was with as be on by at this are an a or from his her not but have which "
    "de la le et les des en un une du que est pour qui dans au par plus avec il ne se sur pas "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es "
    "el los las y del con su para al lo como más"
)
RULES = rf"""
    WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    words AS (
      SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i
      FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts)
    ),
    runs AS (
      SELECT rid, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d, lead(word, 4) OVER o AS e
      FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)
    ),
    repeats AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, word, b, c, d, e) AS n FROM runs WHERE e IS NOT NULL) WHERE n > 1),
    covered AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM repeats, range(5) r(j) GROUP BY rid),
    of_words AS (
      SELECT rid, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars,
        count(*) FILTER (list_contains(string_split('{STOP_WORDS}', ' '), lower(trim(word, '.,;:()"''')))) AS n_stop
      FROM words GROUP BY rid
    ),
    lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM texts),
    of_lines AS (
      SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
        count(*) FILTER (regexp_matches(line, '^[ \t]*[-•*‣▪·] ')) AS n_bullets,
        count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[ \t\r]*$')) AS n_ellipses
      FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
    ),
    facts AS (
      SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_stop, 0) AS n_stop, coalesce(n_lines, 0) AS n_lines,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(n_bullets, 0) AS n_bullets, coalesce(n_ellipses, 0) AS n_ellipses
      FROM texts LEFT JOIN of_words USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN of_lines USING (rid)
    ),
    judged AS (
      SELECT *, list_filter([
          CASE WHEN n_words < 10 THEN 'few_words' END,
          CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 'repeated_words' END,
          CASE WHEN n_words >= 20 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 'word_length' END,
          CASE WHEN n_words > 0 AND 10 * n_symbols > n_words THEN 'symbols' END,
          CASE WHEN n_words >= 50 AND 25 * n_stop < n_words THEN 'stop_words' END,
          CASE WHEN 5 * n_dup_lines > 2 * n_lines THEN 'repeated_lines' END,
          CASE WHEN 10 * n_bullets > 9 * n_lines THEN 'bullet_lines' END,
          CASE WHEN 10 * n_ellipses > 3 * n_lines THEN 'ellipsis_lines' END
        ], lambda x: x IS NOT NULL) AS failed
      FROM facts
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, len(failed) = 0 AS kept,
      array_to_string(failed, ',') AS failed
    FROM judged
"""


RESAMPLED = r"""
    WITH RECURSIVE steps AS (
      SELECT range AS n, 0 AS k, range::BIGINT AS c FROM range(256)
      UNION ALL
      SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM steps WHERE k < 8
    ),
    crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
    texts AS (
      SELECT row_number() OVER () AS rid, doc_id, 0 AS target, coalesce(text, '') AS t FROM documents
      UNION ALL
      SELECT NULL, NULL, 1, coalesce(text, '') FROM benchmark
    ),
    words AS (
      SELECT rid, target, unnest(regexp_extract_all(
        translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
      FROM texts
    ),
    counted AS (SELECT rid, target, word, count(*) AS n FROM words GROUP BY rid, target, word),
    named AS (
      SELECT word, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS b
      FROM (SELECT DISTINCT word FROM counted)
    ),
    hashed AS (
      SELECT word,
        xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 AS bucket
      FROM named, crc
    ),
    in_buckets AS (SELECT rid, target, bucket, sum(n) AS n FROM counted JOIN hashed USING (word) GROUP BY rid, target, bucket),
    totals AS (SELECT coalesce(sum(n) FILTER (target = 0), 0) AS all_s, coalesce(sum(n) FILTER (target = 1), 0) AS all_t FROM in_buckets),
    gains AS (
      SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
      FROM (
        SELECT bucket, coalesce(sum(n) FILTER (target = 0), 0) AS s, coalesce(sum(n) FILTER (target = 1), 0) AS t
        FROM in_buckets GROUP BY bucket
      ), totals
    ),
    weighed AS (
      SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
      FROM in_buckets JOIN gains USING (bucket) WHERE target = 0 GROUP BY rid
    ),
    scored AS (
      SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln(
          (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM texts LEFT JOIN weighed USING (rid) WHERE texts.target = 0
    ),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
        count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn
      FROM scored
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM placed
"""


def oracle_sql(n_shards: int) -> dict[str, str]:
    return {
        "op3_shards": shards(n_shards),
        "op5_secrets": found_secrets(),
        "op10_topk": TOP_K,
        "op11_resampling": RESAMPLED,
        "op13_rules": RULES,
    }
