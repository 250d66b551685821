"""The driver-facing queries of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, lm, minhash, pieces, quality, rollups, secrets, sentences, suffixes
from .common import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).drop("class_distance", "common_distance")


def op2_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.token_totals(documents(spark, sf_dir))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("hamming")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.summary(documents(spark, sf_dir))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(documents(spark, sf_dir)).drop("n_links")


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.summary(documents(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.classify(documents(spark, sf_dir))


def word_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollups of the white-space tokenizer alone, which SQL can count."""
    return rollups.token_totals(documents(spark, sf_dir), rollups.Tokenizers(ranks={}))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the secret scan finds by its fixed patterns, without the compressor's spans."""
    return op3_secret_scans(spark, sf_dir).drop("spans", "n_novel")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base score of the language model, to six digits."""
    return op8_lm_scoring(spark, sf_dir).withColumn("base_score", F.floor(F.col("base_score") * 1e6 + 0.5).cast("long")).drop("score")


def language_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents language ID holds out, and which have no language."""
    return op10_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("unknown"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_token_rollups, op3_secret_scans, op4_decontamination, op5_suffix_dedup,
        op6_minhash_near_dedup, op7_sentence_spans, op8_lm_scoring, op9_sentencepiece, op10_language_id,
        word_rollups, secret_base_spans, lm_base_scores, language_held_out,
    )
}

_RULES = quality.QualityRules()
_CLASS = {"vowel": "[aeiou]", "consonant": "[b-df-hj-np-tv-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[\x09\x0B-\x0D\x1C-\x1F\x20]", "newline": r"\n", "stop": "[.,;:!?]", "symbol": "[#*$%&|<>]", "beyond_ascii": r"[^\x00-\x7F]"}
_COUNTS = ", ".join(f"length(text) - length(regexp_replace(text, '{p}', '', 'g')) AS {c}" for c, p in _CLASS.items())
_LOG = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: crc32 of an id's decimal text.
_CRC32 = "xor(list_reduce(list_transform(range(length({0}::VARCHAR)), lambda i: ascii(substr({0}::VARCHAR, i::INT + 1, 1))::BIGINT), lambda c, b: list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b)), 4294967295), 4294967295)"
_HELD = "coalesce(" + _CRC32 + " % {1} = 2, false)"
_PATTERNS = {"assign": r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA([A-Z0-9]+)", "hex": "([0-9a-f]+)"}
_LEAST = {"assign": "length(regexp_extract(m, '" + _PATTERNS["assign"] + "', 1)) >= 12", "access": "length(m) >= 18", "hex": "length(m) >= 16"}
#: Matches of a pattern with their places, from the pieces of text between them.
_PLACED = "SELECT rid, '{0}' AS kind, {1} AS place, m, s FROM (SELECT rid, unnest(ms) AS m, unnest(list_transform(range(len(ms)), lambda i: list_sum(list_transform(gaps[1 : i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1 : i], lambda x: length(x))), 0)))::BIGINT AS s FROM (SELECT rid, regexp_extract_all(t, '{2}') AS ms, regexp_split_to_array(t, '{2}') AS gaps FROM d)) WHERE {3}"
_FOUND = " UNION ALL ".join(_PLACED.format(k, i, p, _LEAST[k]) for i, (k, p) in enumerate(_PATTERNS.items()))

ORACLE_SQL: dict[str, str] = {
    "word_rollups": f"SELECT source, lang, 'words' AS tokenizer, count(*) AS n_docs, sum(len({_WORDS.format('coalesce(text, chr(32))')}))::BIGINT AS n_tokens FROM documents GROUP BY 1, 2",
    "secret_base_spans": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), f AS ({_FOUND}),
      g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, place) AS spans FROM f GROUP BY 1)
      SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (rid)""",
    # add-one unigrams over the tokens of the documents that aren't held out; the end of a text is a token
    "lm_base_scores": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_HELD.format("doc_id", 7)} AS held_out, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} || ['\\x20end'] AS w FROM documents),
      t AS (SELECT rid, held_out, unnest(w) AS x FROM d), c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c),
      s AS (SELECT rid, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 1) / (n.n + v + 1)::DOUBLE)) AS b FROM t LEFT JOIN c USING (x), n GROUP BY 1)
      SELECT doc_id, held_out, n_tokens, n_known, n.n AS train_tokens, floor(b * 1000000 + 0.5)::BIGINT AS base_score FROM d JOIN s USING (rid), n""",
    "language_held_out": f"SELECT doc_id, {_HELD.format('doc_id', 4)} AS held_out, NOT coalesce(regexp_matches(text, '\\p{{L}}'), false) AS unknown FROM documents",
    # base figures; distances of normalised histograms from their language's mean, of classes from that of all where it has none
    "op1_quality_rules": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
      w AS (SELECT rid, {_WORDS.format("text")} AS w FROM d), t AS (SELECT rid, generate_subscripts(w, 1) AS p, unnest(w) AS x FROM w),
      g AS (SELECT rid, p, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM t WINDOW o AS (PARTITION BY rid ORDER BY p)),
      twice AS (SELECT rid, unnest([p, p + 1, p + 2]) AS p FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
      rep AS (SELECT rid, count(DISTINCT p) AS n FROM twice GROUP BY 1),
      ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d), dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
      b AS (SELECT d.rid, doc_id, lang, len(w.w) AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(text) AS chars, {_COUNTS} FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
      fit AS (SELECT rid, lang, count(*) OVER (PARTITION BY lang) AS n FROM b WHERE lang IS NOT NULL AND n_words >= {_RULES.min_words_for_common} AND chars >= {_RULES.min_chars_for_classes}),
      low AS (SELECT rid, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM t),
      voc AS (SELECT lang, x FROM low JOIN fit USING (rid) WHERE n >= {_RULES.min_reference_docs} GROUP BY lang, x QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, x) <= {_RULES.common_words}),
      k AS (SELECT b.*, v.lang AS key FROM b LEFT JOIN (SELECT DISTINCT lang FROM voc) v USING (lang)),
      wide AS (UNPIVOT (SELECT rid, key, n_words, chars, {", ".join(_CLASS)}, chars - ({" + ".join(_CLASS)}) AS mark FROM k) ON {", ".join(_CLASS)}, mark INTO NAME slot VALUE c),
      cw AS (SELECT rid, voc.x AS slot, count(*) AS c FROM low JOIN k USING (rid) JOIN voc ON voc.lang = k.key AND voc.x = low.x GROUP BY 1, 2),
      h AS (SELECT rid, key, 'class' AS kind, slot, c / greatest(chars, 1)::DOUBLE AS p FROM wide UNION ALL SELECT rid, key, 'common', slot, c / n_words::DOUBLE FROM cw JOIN k USING (rid)
        UNION ALL SELECT rid, key, 'common', ' other', (n_words - coalesce(s.c, 0)) / greatest(n_words, 1)::DOUBLE FROM k LEFT JOIN (SELECT rid, sum(c) AS c FROM cw GROUP BY 1) s USING (rid) WHERE key IS NOT NULL),
      long AS (SELECT rid, lang FROM b WHERE n_words >= {_RULES.min_words_for_common} AND chars >= {_RULES.min_chars_for_classes}),
      ref AS (SELECT key, kind, slot, sum(p) / (SELECT count(*) FROM long WHERE lang = key) AS q FROM h JOIN long USING (rid) WHERE key IS NOT NULL GROUP BY 1, 2, 3
        UNION ALL SELECT NULL, kind, slot, sum(p) / (SELECT count(*) FROM long) FROM h JOIN long USING (rid) WHERE kind = 'class' GROUP BY 2, 3),
      every AS (SELECT rid, kind, slot, q FROM k JOIN ref ON ref.key IS NOT DISTINCT FROM k.key),
      js AS (SELECT e.rid, e.kind, sqrt(greatest(0, sum({_LOG.format("coalesce(p, 0)", "coalesce(q, 0)")} + {_LOG.format("coalesce(q, 0)", "coalesce(p, 0)")}) / 2)) AS d FROM every e LEFT JOIN h ON h.rid = e.rid AND h.kind = e.kind AND h.slot = e.slot GROUP BY 1, 2),
      own AS (SELECT rid, max(d) FILTER (kind = 'class') AS a, max(d) FILTER (kind = 'common') AS c FROM js GROUP BY 1),
      v AS (SELECT b.*, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_pct} * n_words AS base_failed,
        CASE WHEN chars >= {_RULES.min_chars_for_classes} THEN coalesce(a, 0) ELSE 0 END AS a, CASE WHEN n_words >= {_RULES.min_words_for_common} THEN coalesce(c, 0) ELSE 0 END AS c FROM b LEFT JOIN own USING (rid))
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND a <= {_RULES.max_class_distance} AND c <= {_RULES.max_common_distance} AS kept FROM v""",
    # best window of an item's size for each document and item, by exact weighted similarity; only windows with enough of the items' shingles
    "op4_decontamination": r"""WITH d AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
      i AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark),
      ds AS (SELECT doc_id, len(w) AS nw, p, CASE WHEN len(w) >= 5 THEN array_to_string(w[p + 1 : p + 5], ' ') ELSE array_to_string(w, ' ') END AS g FROM (SELECT *, unnest(range(greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)),
      sh AS (SELECT item_id, len(w) AS size, p, CASE WHEN len(w) >= 5 THEN array_to_string(w[p + 1 : p + 5], ' ') ELSE array_to_string(w, ' ') END AS g FROM (SELECT *, unnest(range(greatest(len(w) - 4, 1))) AS p FROM i WHERE len(w) > 0)),
      hits AS (SELECT doc_id, nw, ds.p, k.size, greatest(k.size - 4, 1) AS n FROM ds JOIN (SELECT DISTINCT size, g FROM sh) k USING (g)),
      st AS (SELECT doc_id, size, n, nw, unnest(range(least(greatest(p - n + 1, 0), greatest(nw - size, 0)), least(p, greatest(nw - size, 0)) + 1)) AS start FROM hits),
      win AS (SELECT doc_id, size, n, start FROM st GROUP BY doc_id, size, n, nw, start HAVING count(*) >= 0.8 / 1.8 * (least(n, greatest(nw - 4, 1)) + n) - 0.000001),
      wg AS (SELECT win.doc_id, size, start, g, count(*) AS c FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.p >= start AND ds.p < start + n GROUP BY ALL),
      ws AS (SELECT doc_id, size, start, sum(c) AS total FROM wg GROUP BY ALL),
      ig AS (SELECT item_id, g, count(*) AS c, sum(count(*)) OVER (PARTITION BY item_id) AS total FROM sh GROUP BY item_id, g),
      sim AS (SELECT wg.doc_id, ig.item_id, wg.start, wg.size, sum(least(wg.c, ig.c)) AS shared, any_value(ws.total) + any_value(ig.total) AS mass FROM wg JOIN ws USING (doc_id, size, start) JOIN ig USING (g) GROUP BY ALL)
      SELECT doc_id, item_id, start::BIGINT AS start_word, size::BIGINT AS n_words, round(shared / (mass - shared)::DOUBLE, 9) AS similarity FROM sim WHERE shared / (mass - shared)::DOUBLE >= 0.8 - 1e-12
      QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / (mass - shared)::DOUBLE DESC, start, size DESC) = 1""",
    # every run of 50 words that stands elsewhere too, joined; the least place of each stays
    "op5_suffix_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
      s AS (SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + 50], ' ')) AS k FROM (SELECT *, unnest(range(len(w) - 49)) AS p FROM d WHERE len(w) >= 50)),
      m AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(p) OVER o AS fp, count(*) OVER (PARTITION BY k) AS c FROM s WINDOW o AS (PARTITION BY k ORDER BY doc_id, p)),
      l AS (SELECT doc_id, p, k FROM m WHERE c > 1 AND (doc_id <> fd OR p - fp >= 50)),
      e AS (SELECT doc_id, p, 1 AS a, 1 AS r FROM l UNION ALL SELECT fd, fp, 1, 0 FROM (SELECT DISTINCT fd, fp, k FROM m JOIN l USING (doc_id, p, k))),
      x AS (SELECT doc_id, p, 'a' AS kind FROM e UNION SELECT doc_id, p, 'r' FROM e WHERE r = 1),
      g AS (SELECT *, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, kind ORDER BY p) AS island FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id, kind ORDER BY p) AS q FROM x)),
      z AS (SELECT doc_id, kind, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, kind, island)
      SELECT doc_id, sum(b - a) FILTER (kind = 'a')::BIGINT AS n_repeated, coalesce(sum(b - a) FILTER (kind = 'r'), 0)::BIGINT AS n_removable,
      string_agg(a || ':' || b, ',' ORDER BY a) FILTER (kind = 'a') AS repeated, coalesce(string_agg(a || ':' || b, ',' ORDER BY a) FILTER (kind = 'r'), '') AS removable FROM z GROUP BY doc_id""",
    # components of all pairs with a weighted Jaccard similarity of 0.8 or more; equal multisets of shingles are one text
    "op6_minhash_near_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM documents WHERE doc_id IS NOT NULL),
      s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN md5(array_to_string(w[p + 1 : p + 5], ' ')) ELSE array_to_string(w, ' ') END AS g FROM (SELECT *, unnest(range(greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)),
      c AS (SELECT doc_id, g, count(*) AS c FROM s GROUP BY ALL), t AS (SELECT doc_id, sum(c) AS t FROM c GROUP BY 1),
      e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM c x JOIN c y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN t p ON p.doc_id = x.doc_id JOIN t q ON q.doc_id = y.doc_id GROUP BY 1, 2 HAVING sum(least(x.c, y.c)) >= 0.8 * (any_value(p.t) + any_value(q.t) - sum(least(x.c, y.c))) - 1e-9),
      r AS (SELECT doc_id, doc_id AS class_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.class_id),
      k AS (SELECT doc_id, min(class_id) AS class_id FROM r GROUP BY 1), m AS (SELECT doc_id, md5(string_agg(g || chr(9) || c, chr(10) ORDER BY g)) AS m FROM c GROUP BY 1)
      SELECT doc_id, class_id, CASE WHEN m IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY m) END AS text_id FROM k LEFT JOIN m USING (doc_id)""",
    # sentences that a repeated run of at least two sentences and twenty words covers, but for its first place
    "op7_sentence_spans": rf"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS line, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)),
      w AS (SELECT doc_id, line, generate_subscripts(v, 1) AS k, len(v) AS n, unnest(v) AS word FROM (SELECT doc_id, line, {_WORDS.format("t")} AS v FROM l)),
      hard AS (SELECT doc_id, word, row_number() OVER o - 1 AS pos, (k = n OR regexp_matches(word, '[.!?]$'))::INT AS stop FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY line, k)),
      run AS (SELECT *, sum(stop) OVER (PARTITION BY doc_id ORDER BY pos) - stop AS r FROM hard),
      f AS (SELECT doc_id, word, pos, greatest(stop, (pos - min(pos) OVER (PARTITION BY doc_id, r) >= 24 AND (strlen(word) * 5 + ('0x' || left(hex(word), 2))::INT) % 8 = 0)::INT) AS stop FROM run),
      i AS (SELECT *, sum(stop) OVER (PARTITION BY doc_id ORDER BY pos) - stop AS s FROM f),
      a AS (SELECT doc_id, list(word ORDER BY pos) AS words FROM f GROUP BY 1),
      s AS (SELECT doc_id, s::BIGINT AS s, min(pos) AS first, max(pos) + 1 AS after FROM i GROUP BY 1, 2),
      p AS (SELECT x.doc_id, x.s AS i, min(y.s) AS j, x.first, min(y.after) AS after FROM s x JOIN s y ON y.doc_id = x.doc_id AND y.s >= x.s + 1 AND y.after - x.first >= 20 GROUP BY x.doc_id, x.s, x.first),
      k AS (SELECT p.*, md5(array_to_string(words[first + 1 : after], ' ')) AS key FROM p JOIN a USING (doc_id)),
      m AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(i) OVER o AS fi FROM k WINDOW o AS (PARTITION BY key ORDER BY doc_id, i)),
      r AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS s FROM m WHERE doc_id <> fd OR i <> fi),
      o AS (SELECT doc_id, string_agg(fd::VARCHAR, ',' ORDER BY fd) AS first_docs FROM (SELECT DISTINCT doc_id, fd FROM m WHERE doc_id <> fd OR i <> fi) GROUP BY 1)
      SELECT doc_id, count(*) AS n_removed, string_agg(s::VARCHAR, ',' ORDER BY s) AS sentences, any_value(first_docs) AS first_docs FROM r JOIN o USING (doc_id) GROUP BY doc_id""",
}
