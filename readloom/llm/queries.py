"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import alignment, bpe_tree, langid, merkle, mixing, phrases, quality, simhash, suffixes, token_counts, topk, urlfilter, warc
from readloom.llm.common import shared_folder, table

#: host, path, verdict
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprints(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty in each call, so that a call does all its work."""
    cache = f"{shared_folder(spark).rstrip('/')}/token-cache-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json"), cache)


def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_documents(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.near_copies(table(spark, sf_dir, "documents"))
    return made.withColumn("fingerprint", simhash.as_hex(F.col("fingerprint")))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = quality.fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.filter(~held))
    return docs.select(
        "doc_id",
        F.coalesce(held, F.lit(False)).alias("held_out"),
        langid.predictor(spark, model)("text").alias("p"),
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return warc.records(warc.write(table(spark, sf_dir, "pages"), folder))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.unheld(table(spark, sf_dir, "labels")))
    return docs.select(
        "doc_id",
        F.coalesce(quality.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        quality.scorer(spark, model)("text").alias("score"),
    ).withColumn("predicted", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0))


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.kept_digests(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), digest=True)
    return made.withColumnRenamed("groups", "groups_sha256")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_fingerprints": op2_fingerprints,
    "op3_token_counts": op3_token_counts,
    "op4_bpe_tree": op4_bpe_tree,
    "op5_simhash": op5_simhash,
    "op6_topk": op6_topk,
    "op7_language": op7_language,
    "op8_warc": op8_warc,
    "op9_url_filter": op9_url_filter,
    "op10_quality": op10_quality,
    "op11_suffixes": op11_suffixes,
    "op12_alignment": op12_alignment,
    "op13_merkle": op13_merkle,
}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


def _merkle_sql(levels: int = 6, top_levels: int = 4) -> str:
    """Trees of up to 16 ** levels leaves a source and 16 ** top_levels sources; a tree that has ended is carried on."""
    fields = ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", "text")
    framed = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """list_reduce(list_concat([4294967295], flatten(list_transform(str_split(cast(doc_id as varchar), ''),
        lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: case when x >= 0 then xor(a, x)
        when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)"""
    steps = [
        f"""l as (select row_number() over () as rid, doc_id, coalesce('+' || source, '') as tree,
            sha256({" || ".join(map(framed, fields))}) as leaf,
            case when xor({crc}, 4294967295) % 5 = 0 and text is not null
                 then sha256({" || ".join(map(framed, (*fields[:-1], lowered)))}) end as tampered from documents)""",
        """s0 as (select rid, tree, leaf as h, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx,
            count(*) over (partition by tree) as n from l)""",
    ]

    def above(name: str, k: int) -> None:
        steps.append(
            f"""{name}{k + 1} as (select tree, idx // 16 as idx, (n + 15) // 16 as n,
                case when n > 1 then sha256(string_agg(h, '' order by idx)) else min(h) end as h
                from {name}{k} group by tree, idx // 16, n)"""
        )

    def beside(name: str, k: int) -> None:
        over = "over (partition by tree, idx // 16 order by idx rows between"
        steps.append(
            f"""{name}p{k} as (select *, coalesce(string_agg(h, '') {over} unbounded preceding and 1 preceding), '') as a,
                coalesce(string_agg(h, '') {over} 1 following and unbounded following), '') as b from {name}{k})"""
        )

    for k in range(levels):
        above("s", k)
        beside("s", k)
    steps.append(
        f"""t0 as (select tree as of, 0 as tree, h, row_number() over (order by tree) - 1 as idx, count(*) over () as n
            from s{levels})"""
    )
    for k in range(top_levels):
        above("t", k)
        beside("t", k)
    steps.append(
        """f0 as (select l.doc_id, l.leaf, l.tree, s.idx, t.idx as tidx, t.h as subroot, '' as proof,
            coalesce(tampered, leaf) as node from l join sp0 s using (rid) join t0 t on t.of = l.tree)"""
    )
    for k in range(levels + top_levels):
        name, level = ("sp", k) if k < levels else ("tp", k - levels)
        on = f"p.tree = f.tree and p.idx = f.idx // {16**level}" if k < levels else f"p.idx = f.tidx // {16**level}"
        steps.append(
            f"""f{k + 1} as (select f.* replace (f.proof || p.a || p.b as proof,
                case when p.n > 1 then sha256(p.a || node || p.b) else node end as node) from f{k} f join {name}{level} p on {on})"""
        )
    return f"""with {", ".join(steps)}
        select doc_id, leaf, subroot, r.h as root, sha256(proof) as proof_sha256, node as folded_root, node = r.h as verified
        from f{levels + top_levels}, t{top_levels} r"""


ORACLE = {
    "op13_merkle": _merkle_sql(),
    "op6_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
            select q.vec_id as query_id, c.vec_id,
                   cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
        select query_id, cast(rank as integer) as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
        where rank <= 10
    """,
    "op8_warc": """
        with p as (
            select page_id, coalesce(html, '') as html from pages),
        d as (
            select page_id, strlen(html) as payload_bytes, sha1(html) as hex from p),
        b as (
            select page_id, payload_bytes, hex,
                   array_to_string(list_transform(range(0, 8), lambda g:
                       array_to_string(list_transform([15, 10, 5, 0], lambda s:
                           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                                  ((cast('0x' || substr(hex, cast(g * 5 + 1 as int), 5) as bigint) >> s) & 31) + 1, 1)), '')), '')
                   as payload_digest
            from d),
        f as (select hex, min(page_id) as first from b group by hex)
        select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
               case when page_id = first then 'response' else 'revisit' end as record_type,
               case when page_id <> first then first end as refers_to
        from b join f using (hex)
    """,
    "op9_url_filter": rf"""
        with rules(rhost, rpath, rverdict) as (values {_RULES_SQL}),
        u as (
            select page_id,
                   translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path
            from pages),
        best as (
            select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule,
                   arg_max(rverdict, length(rhost || rpath)) as verdict
            from u join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
            group by page_id)
        select u.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
        from u left join best using (page_id)
    """,
}
