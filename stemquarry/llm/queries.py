"""The opN_ queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .block_topk import top_k
from .cost_packing import pack_documents
from .hnsw import nearest
from .license_templates import licenses
from .passage_dedup import repeats
from .pii_crf import personal_data
from .piece_viterbi import encode_documents
from .pivot_phrases import collocations
from .quality_crf import quality
from .secret_dfa import secrets
from .set_join import jaccard_components
from .spelling_variants import _CRC, spelling_variants
from .suffix_dedup import substring_dedup


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_secret_dfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, model_path=public_tokenizers.path("piece_bpe_32k.model"))


def op7_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


def op8_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        json_path=public_tokenizers.path("byte_bpe_50k.json"),
        ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_pivot_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_crf": op1_quality_crf,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_license_templates": op3_license_templates,
    "op4_pii_crf": op4_pii_crf,
    "op5_secret_dfa": op5_secret_dfa,
    "op6_piece_viterbi": op6_piece_viterbi,
    "op7_block_topk": op7_block_topk,
    "op8_cost_packing": op8_cost_packing,
    "op9_hnsw": op9_hnsw,
    "op10_passage_dedup": op10_passage_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_pivot_phrases": op12_pivot_phrases,
    "op13_suffix_dedup": op13_suffix_dedup,
}

#: Byte table of CRC-32 by its rule, for SQL.
_CRC_SQL = "[" + ", ".join(str(x) for x in _CRC.tolist()) + "]"
_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Operators whose whole result is SQL: every pair of documents that share a shingle and the groups
#: that links reach, and every inner product.  The others' models, automata, graphs and token ids aren't.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": r"""
        with recursive words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
        ), sets as (
            select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end s from words
        ), classes as (select min(doc_id) rep, s from (select doc_id, list_sort(s) s from sets) group by s having len(s) > 0),
        elements as (select rep, len(s) n, unnest(s) e from classes),
        links as (
            select a.rep a, b.rep b from elements a join elements b on a.e = b.e and a.rep <> b.rep and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n
            group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reach as (select rep node, rep other from classes union select r.node, l.b from reach r join links l on r.other = l.a),
        components as (select node, min(other) component from reach group by node)
        select x.doc_id, len(x.s) n_shingles, coalesce(component, x.doc_id) component_id
        from (select doc_id, list_sort(s) s from sets) x left join classes on x.s = classes.s left join components on rep = node""",
    "op7_block_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) w from embeddings
            where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scores as (
            select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) as bigint) score
            from (select * from v where vec_id % 50 = 0) q join v c on q.vec_id <> c.vec_id and len(q.w) = len(c.w)
        ), ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) n from scores)
        select query_id, cast(n as integer) "rank", vec_id, score from ranked where n <= 5""",
    "op11_spelling_variants": f"""
        with recursive found as (
            select doc_id, unnest(regexp_extract_all({_LOWER_SQL.format("text")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) run from documents where text is not null
        ), each as (select doc_id, run, count(*) times from found where length(run) >= 7 group by 1, 2),
        bytes as (select run, times, doc_id, hex(encode(doc_id || ':' || run)) x from each),
        hashed as (
            select run, times, doc_id, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: (position(x[2 * i + 1] in '0123456789ABCDEF') - 1) * 16 + position(x[2 * i + 2] in '0123456789ABCDEF') - 1),
                lambda s, b: xor(cast({_CRC_SQL}[xor(s, b) % 256 + 1] as bigint), s >> 8), cast(4294967295 as bigint)), 4294967295) h from bytes
        ), cut as (select case when h % 31 = 0 then run[1:h % length(run)] || run[h % length(run) + 2:] else run end word, times from hashed),
        words as (select word, cast(sum(times) as bigint) n from cut where length(word) >= 7 group by 1 having sum(times) >= 2),
        holes as (select word, n, unnest(range(1, length(word) + 1)) i, word[1:i - 1] || word[i + 1:] rest from words),
        near as (
            select a.word, b.word other, b.n from holes a join holes b on a.rest = b.rest and a.i = b.i and a.word <> b.word and length(a.word) = length(b.word)
            union select a.word, b.word, b.n from words a join holes b on b.rest = a.word
            union select b.word, a.word, a.n from words a join holes b on b.rest = a.word
        ), best as (select word, count(*) n_near, max(n) most from near group by 1),
        forms as (select b.word, min(x.other) form, most from best b join near x on b.word = x.word and x.n = b.most join words w on w.word = b.word where most >= 10 * w.n group by 1, 3),
        ways as (select word, form top, 1 steps from forms union all select ways.word, forms.form, steps + 1 from ways join forms on ways.top = forms.word),
        ends as (select word, max_by(top, steps) root from ways group by 1)
        select w.word, form, coalesce(root, w.word) root, w.n, coalesce(n_near, 0) n_near, case when form is not null then f.most end form_n
        from words w left join best b on w.word = b.word left join forms f on w.word = f.word left join ends e on w.word = e.word""",
    "op12_pivot_phrases": f"""
        with pieces as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array({_LOWER_SQL.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) piece from documents),
        worded as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') w from pieces),
        totals as (select lang, cast(sum(len(w)) as bigint) n from worded group by 1),
        grams as (select lang, unnest(flatten([[w[i:i + k - 1] for i in range(1, len(w) - k + 2)] for k in range(1, 5)])) g from worded),
        counts as (select lang, g, count(*) f from grams group by 1, 2 having count(*) >= 30),
        cuts as (select lang, g, f a, unnest(range(1, len(g))) k from counts where len(g) > 1),
        scored as (select c.lang, c.g, a, k, x.f l, y.f r, (2000000::hugeint * a) // (x.f + y.f) score from cuts c join counts x on c.lang = x.lang and c.g[1:k] = x.g join counts y on c.lang = y.lang and c.g[k + 1:] = y.g),
        lowest as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1),
        inner_parts as (select distinct lang, f, unnest(flatten([[g[s:s + m - 1] for s in range(1, len(g) - m + 2)] for m in range(2, len(g))])) g from counts where len(g) > 2),
        over_parts as (select lang, g, max(f) longer from inner_parts group by 1, 2),
        kept as (select k.* from lowest k left join over_parts o on k.lang = o.lang and k.g = o.g where longer is null or 100::hugeint * longer < 80::hugeint * a),
        named as (select lang, array_to_string(g, ' ') phrase, a, l, r, score from kept)
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) "rank", phrase, a, l, r, n, cast(score as bigint) score
        from named join totals using (lang) qualify "rank" <= 2000""",
    "op13_suffix_dedup": """
        with raw as (select doc_id, encode(coalesce(text, '')) b from documents),
        numbered as (select row_number() over () r, doc_id, b, octet_length(b) n from raw),
        windows as (select r, unnest(range(1, n - 398)) pos from numbered where n >= 400),
        hashed as (select w.r, pos, md5(b[pos:pos + 399]) h from windows w join numbered using (r)),
        starts as (select r, pos from hashed qualify count(*) over (partition by h) > 1),
        marked as (select r, pos, case when pos - lag(pos) over (partition by r order by pos) <= 400 then 0 else 1 end as opens from starts),
        spanned as (select r, pos, sum(opens) over (partition by r order by pos) span from marked),
        spans as (select r, span, min(pos) a, max(pos) + 400 b from spanned group by 1, 2),
        cuts as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 1) as done, row_number() over (partition by r order by a desc) = 1 as final from spans),
        kept as (select r, sum(c.b - a) removed, count(*) spans, string_agg(hex(x.b[done:a - 1]) || case when final then hex(x.b[c.b:]) else '' end, '' order by a) kept from cuts c join numbered x using (r) group by 1)
        select doc_id, n n_bytes, cast(coalesce(removed, 0) as bigint) n_removed, coalesce(spans, 0) n_spans, sha256(coalesce(unhex(kept), b)) kept_sha256
        from numbered left join kept using (r)""",
}
