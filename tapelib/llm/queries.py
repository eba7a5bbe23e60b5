"""The registered queries over documents, pages, benchmark and labels, and their SQL statements where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelib.llm import collocations, decontamination, exact_dedup, harmonic, hmm, licences, merkle, near_dedup, packing, substring_dedup, token_files, toxicity, warc
from tapelib.llm.store import new_path, stored

#: Names of vocabulary files in the folder of public tokenizers.
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_substring_dedup", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
    f AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g),
    r AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS pos FROM g JOIN f USING (g) WHERE low < doc_id),
    n AS (SELECT doc_id, count(*) AS n_removed, list(pos) AS gone FROM r GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
           sha256(coalesce(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
    FROM d LEFT JOIN n USING (doc_id)""")
def op1(spark, sf):
    """One row per document: words left after repeated passages were removed."""
    left = substring_dedup.remove_repeats(table(spark, sf, "documents"))
    return left.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query("op2_hyperminhash", r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS g FROM d WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
    u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
    r(doc_id, low) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.y, r.low FROM r JOIN u ON u.x = r.doc_id WHERE r.low < u.y),
    m AS (SELECT doc_id, min(low) AS component_id FROM r GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""")
def op2(spark, sf):
    """One row per document: its group of near duplicates over two-word shingles."""
    groups = near_dedup.near_groups(table(spark, sf, "documents"), k=2)
    return groups.withColumnRenamed("id", "doc_id")


@query("op3_pattern_packing")
def op3(spark, sf):
    """One row per piece of a document: its place in sequences of at most 4,096 tokens."""
    pieces = stored(packing.token_pieces(table(spark, sf, "documents"), vocabulary(WORD_BPE), spaced=False, end_id=1, capacity=4096), "pieces")
    return packing.pack(pieces, 4096).withColumnRenamed("id", "doc_id")


@query("op4_exact_dedup", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t)""")
def op4(spark, sf):
    """One row per document: the largest doc_id among equal texts stays."""
    g = exact_dedup.exact_groups(table(spark, sf, "documents"), keep="max")
    each = g.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return each.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha256").alias("text_sha256"))


def remainder(id_col: str, by: int):
    """crc32 of the id as text, modulo ``by``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(by))


@query("op5_toxicity")
def op5(spark, sf):
    """One row per document: a score of toxicity, learnt from labels outside the held-out rows."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf, "labels"), remainder("id", 4) != 2)
    scored = toxicity.score(docs, model).select("doc.doc_id", "score")
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op6_token_files")
def op6(spark, sf):
    """One row per document, read back from the token files through their index."""
    docs, folder = table(spark, sf, "documents"), new_path(spark, "token-files")
    index = token_files.write_token_files(docs, folder, vocabulary(BYTE_BPE), spaced=True, end_id=0)
    keys = docs.groupBy(F.col("doc_id").alias("id")).count().select("id", F.explode(F.expr("sequence(0, cast(count - 1 AS int))")).alias("copy"))
    read = token_files.read_tokens(token_files.find_tokens(keys, folder, max(1, index.count())), folder, with_ids=False)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op8_decontamination", f"""
    WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []::VARCHAR[]) AS w FROM documents),
    i AS (SELECT cast(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
    p AS (SELECT DISTINCT item, array_to_string(w[k:k + 12], ' ') AS phrase, least(len(w), 13) AS n
          FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM p),
    g AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS phrase
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
    o AS (SELECT doc_id, item, k, g.n FROM g JOIN p USING (phrase) WHERE g.n = p.n),
    h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM o) GROUP BY doc_id),
    t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op8(spark, sf):
    """One row per document: words inside benchmark phrases, and the items they come from."""
    found = decontamination.find_phrases(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontamination.sha256_of_items().alias("items_sha256"), decontamination.contaminated().alias("contaminated"))


@query("op10_hmm_scores")
def op10(spark, sf):
    """One row per document: unigram and hidden Markov log10 probabilities, learnt from nine tenths of the documents."""
    scored = hmm.score(table(spark, sf, "documents"), remainder("id", 10) != 0)
    return scored.select(F.col("id").alias("doc_id"), (remainder("id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op7_warc_audit", """
    SELECT page_id, sha256(coalesce(html, '')) AS payload_sha256, strlen(coalesce(html, '')) AS payload_bytes, page_id % 50 = 0 AS damaged FROM pages""")
def op7(spark, sf):
    """One row per page: its payload as read back from the WARC shards, and whether an audit of a second replica, in which one
    byte of every fiftieth page was changed on purpose, found its record damaged."""
    ours, theirs = new_path(spark, "warc"), new_path(spark, "warc-replica")
    manifest = warc.write_warc(table(spark, sf, "pages"), ours)
    warc.copy_warc(manifest, ours, theirs, F.col("id") % 50 == 0).count()
    bad = warc.audit(warc.merkle_tree(manifest), warc.merkle_tree(warc.read_records(manifest, theirs)))
    pages = warc.read_records(manifest, ours, with_payload=True)
    found = pages.join(bad.withColumn("bad", F.lit(True)), ["shard", "place"], "left")
    return found.select(F.col("id").alias("page_id"), "payload_sha256", "payload_bytes", F.coalesce("bad", F.lit(False)).alias("damaged"))


def _licence_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(licences._plain(s))}, {q(k)})" for k, s in licences.SENTENCES.items())
    rules = ", ".join(f"({q(name)}, {q(',' + ','.join(ids) + ',')})" for name, ids in licences.RULES)
    within = ", ".join(f"({q(a)}, {q(b)})" for a, b in licences.WITHIN.items())
    return rf"""
    WITH known(s, id) AS (VALUES {known}), rules(licence, ids) AS (VALUES {rules}), within(less, more) AS (VALUES {within}),
    d AS (SELECT doc_id, regexp_replace(translate(regexp_replace(coalesce(text, ''), '{licences.LINE}', chr(10) || chr(10) || '\1', 'g'), '{licences.UPPER}', '{licences.LOW}'), '{licences.ENDS}', '|', 'g') AS t FROM documents),
    s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '{licences.OTHER}', ' ', 'g'), '|'), lambda x: trim(x)), lambda x: x <> '') AS s FROM d),
    e AS (SELECT doc_id, generate_subscripts(s, 1) AS k, unnest(s) AS s FROM s),
    i AS (SELECT doc_id, string_agg(id, ',' ORDER BY k) AS ids FROM e JOIN known USING (s) GROUP BY doc_id),
    h AS (SELECT DISTINCT doc_id, licence FROM i JOIN rules ON contains(',' || i.ids || ',', rules.ids)),
    l AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licences FROM h WHERE NOT EXISTS (SELECT 1 FROM within w JOIN h o ON o.licence = w.more AND o.doc_id = h.doc_id WHERE w.less = h.licence) GROUP BY doc_id)
    SELECT doc_id, len(s) AS n_sentences, coalesce(i.ids, '') AS sentence_ids, coalesce(l.licences, '') AS licences FROM s LEFT JOIN i USING (doc_id) LEFT JOIN l USING (doc_id)"""


@query("op9_licence_scan", _licence_sql())
def op9(spark, sf):
    """One row per document: its known licence sentences in order and the licences that they amount to."""
    found = licences.scan(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text: each byte is followed by eight entries -1, one for each bit to shift out."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda x: [cast(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295, {steps}), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


def _merkle_sql(levels: int = 8, tops: int = 3) -> str:
    """Trees of up to 8 ** ``levels`` rows a language and 8 ** ``tops`` languages."""
    leaf = lambda t: "sha256(" + " || ".join(f"coalesce(strlen(cast({c} AS VARCHAR)) || ':' || cast({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", t)) + ")"
    ctes = [f"""d AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {leaf('text')} AS dig, CASE WHEN {_crc32_sql('cast(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS bad FROM documents)""",
            "l0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, dig) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d)"]

    def tree(name: str, height: int) -> None:
        for k in range(height):
            ctes.append(f"{name}{k + 1} AS (SELECT g, pos // 8 AS pos, (max(n) + 7) // 8 AS n, sha256(string_agg(dig, '' ORDER BY pos)) AS dig FROM {name}{k} WHERE n > 1 GROUP BY g, pos // 8)")
            ctes.append(f"s{name}{k} AS (SELECT a.g, a.pos, coalesce(string_agg(b.dig, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS x, coalesce(string_agg(b.dig, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS y "
                        f"FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.g, a.pos)")

    tree("l", levels)
    ctes.append("u AS (" + " UNION ALL ".join(f"SELECT g, dig FROM l{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    ctes.append("t0 AS (SELECT '' AS g, g AS name, dig, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM u)")
    tree("t", tops)
    ctes.append("top AS (" + " UNION ALL ".join(f"SELECT dig FROM t{k} WHERE n = 1" for k in range(tops + 1)) + ")")
    ctes.append("p0 AS (SELECT l0.doc_id, l0.g, l0.pos, t0.pos AS top_pos, l0.dig AS leaf, t0.dig AS subroot, coalesce(bad, l0.dig) AS f, '' AS proof FROM l0 JOIN t0 ON t0.name = l0.g)")
    steps = [(f"sl{k}", "p.g", f"p.pos // {8 ** k}") for k in range(levels)] + [(f"st{k}", "''", f"p.top_pos // {8 ** k}") for k in range(tops)]
    for k, (s, g, pos) in enumerate(steps):
        ctes.append(f"p{k + 1} AS (SELECT p.* EXCLUDE (f, proof), CASE WHEN s.pos IS NULL THEN f ELSE sha256(x || f || y) END AS f, proof || coalesce(x || y, '') AS proof FROM p{k} p LEFT JOIN {s} s ON s.g = {g} AND s.pos = {pos})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, top.dig AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = top.dig AS verified FROM p{len(steps)}, top"


@query("op12_merkle_manifest", _merkle_sql())
def op12(spark, sf):
    """One row per document: its leaf and proof in the manifest's tree, and whether its text, in lower case for every third
    document, still folds to the root."""
    third = remainder("doc_id", 3) == 0
    leaves = merkle.manifest(table(spark, sf, "documents"), "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"],
                             {"text": F.when(third, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))})
    found = leaves.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_hash(F.col("path")).alias("proof_sha256"), merkle.folded(F.col("altered_leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_harmonic_packing")
def op13(spark, sf):
    """One row per piece of a document: its place in sequences of 2,048 tokens."""
    packed = harmonic.pack_documents(table(spark, sf, "documents"), vocabulary(BYTE_BPE), spaced=True, end_id=1, capacity=2048)
    return packed.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


_PIECES = "string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')"


@query("op11_collocations", f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest({_PIECES}) AS p FROM documents),
    w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
    g AS (SELECT lang, size, array_to_string(w[k:k + size - 1], ' ') AS phrase
          FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM w, (VALUES (1), (2), (3)) s(size) WHERE len(w) >= size)),
    f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS c FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
    c AS (SELECT lang, size, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND c >= 10),
    k AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
    h AS MATERIALIZED (SELECT lang, phrase, c FROM f WHERE c >= 10),
    s AS (SELECT k.lang, k.phrase, k.a, k.k, x.c AS l, y.c AS r, ((1000000::HUGEINT * k.a * k.a) // (x.c::HUGEINT * y.c))::BIGINT AS score
          FROM k JOIN h x ON x.lang = k.lang AND x.phrase = k.head JOIN h y ON y.lang = k.lang AND y.phrase = k.tail),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE size = 3) GROUP BY ALL)
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
    FROM b JOIN n ON n.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a
    QUALIFY rank <= 2000""")
def op11(spark, sf):
    """The first 2,000 collocations of two and three words of each language."""
    return collocations.collocations(collocations.phrase_counts(table(spark, sf, "documents"), longest=3, least=10), longest=3, most=2000, cover=50)
