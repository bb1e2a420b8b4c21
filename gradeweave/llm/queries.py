"""The training-data queries: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gradeweave.llm import wavelet

    manifest = wavelet.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.read(manifest).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gradeweave.llm import bpe

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded=True)
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeweave.llm import ngrams

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text")
    return ngrams.score(docs, ngrams.fit(docs.where("not held_out"), order=3))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeweave.llm import secrets

    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = [r.kind for r in secrets.BASE]
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    plain = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *(count(k) for k in base), F.sha2(shown(plain), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeweave.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.decide(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeweave.llm import jaccard

    return jaccard.link(table(spark, sf_dir, "documents"), width=3, percent=90, degrees=False).select("doc_id", "n_shingles", "component_id")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeweave.llm import mixing

    plan = mixing.schedule(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixing.placed(plan).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", F.round("first_position", 6).alias("first_position"))


#: The rules of the url query, as verdict, host and path.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeweave.llm import urls

    judged = urls.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.withColumns({c: F.round(c, 6) for c in ("trust", "distrust")})


def op9_kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeweave.llm import topk

    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("key").alias("vec_id"), "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeweave.llm import repeats

    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeweave.llm import merkle
    from gradeweave.llm.common import ascii_lower

    fields = ("doc_id", "source", "lang", "n_chars")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(chosen, merkle.leaf_digest(*map(F.col, fields), ascii_lower(F.col("text"))))
    found = merkle.proofs(merkle.build(table(spark, sf_dir, "documents"), (*fields, "text"), carry={"tampered": tampered}))
    found = found.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    proof = merkle.proof_digest(F.col("path")).alias("proof_sha256")
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gradeweave.llm import packing

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packed.select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeweave.llm import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("key", "vec_id")


QUERIES = {f.__name__: f for f in (op1_wavelet_matrix, op2_byte_bpe, op3_ngram_scores, op4_secret_scan, op5_quality_rules, op6_ngram_jaccard, op7_source_mix, op8_url_filter, op9_kd_topk, op10_substring_dedup, op11_merkle_manifest, op12_best_fit_packing, op13_embedding_whitening)}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_HOST = "translate(regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NAMED = f"case when starts_with({{0}}, '//') then {_HOST.format("'http:' || {0}")} when regexp_matches({{0}}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {_HOST.format('{0}')} end"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
_MERKLE_LEAF = f"sha256({' || '.join(_FIELD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {_FIELD})"
_CRC32 = """xor(4294967295, list_reduce(list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda i: cast(ascii(substr(cast(doc_id as varchar), i, 1)) as bigint)),
  lambda c, b: list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(c, b)), 4294967295))"""


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"


def _spread(name: str, links: str, seed: str) -> str:
    """Ten rounds of two PageRanks, as a recursive table (round, host, seed, own, alls, heard_own, heard_all)."""
    heard = lambda c: f"0.85e0 * coalesce(sum(l.w * s.{c}), 0e0)"
    return f"""
{name}_links as (select src, dst, n / sum(n) over (partition by src) as w from {links}),
{name}_hosts as (select host, max(seed) as seed from (select host, {seed} as seed from seeds union all select unnest([src, dst]), 0e0 from {name}_links) group by host),
{name}(round, host, seed, own, alls, heard_own, heard_all) as (
  select 0, host, seed, 0.15e0 * seed, 0.15e0, 0e0, 0e0 from {name}_hosts
  union all
  select h.round + 1, h.host, h.seed, 0.15e0 * h.seed + {heard("own")}, 0.15e0 + {heard("alls")}, {heard("own")}, {heard("alls")}
  from {name} h left join {name}_links l on l.dst = h.host left join {name} s on s.host = l.src where h.round < 10 group by h.round, h.host, h.seed
)"""


_SCORE = "round(greatest(seed, coalesce(heard_own / nullif(heard_all, 0e0), 0e0)), 9)"
_LONGEST = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))

ORACLES: dict[str, str] = {
    "op8_url_filter": f"""
with recursive u as (
  select page_id, coalesce(html, '') as html, {_HOST.format("coalesce(url, '')")} as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages
), r as (
  select *, case {" ".join(f"when {_fits(h, p)} then '{h + p}'" for _, h, p in _LONGEST)} end as rule,
    case {" ".join(f"when {_fits(h, p)} then '{v}'" for v, h, p in _LONGEST)} end as given from u
), seeds as (
  select host, avg(case when given = 'allow' then 1e0 else 0e0 end) as good, avg(case when given = 'block' then 1e0 else 0e0 end) as bad from r where host <> '' group by host
), b as (select html, host, regexp_extract(html, '(?i)<base\\s[^<>]*?href\\s*=\\s*["'']?\\s*([^"''\\s<>]+)', 1) as base from u
), a as (
  select host as src, coalesce(nullif({_NAMED.format("base")}, ''), host) as own, unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s<>]+)', 1)) as link from b
), e as (select src, coalesce({_NAMED.format("link")}, own) as dst from a),
edges as (select src, dst, count(*) as n from e where src <> '' and dst <> '' and src <> dst group by src, dst),
back as (select dst as src, src as dst, n from edges),
{_spread("t", "edges", "good")},
{_spread("d", "back", "bad")}
select r.page_id, r.host, r.path, r.rule,
  coalesce(r.given, case when d.score >= 0.5 and d.score > coalesce(t.score, 0) then 'block' else 'allow' end) as verdict,
  round(coalesce(t.score, 0e0), 6) as trust, round(coalesce(d.score, 0e0), 6) as distrust
from r left join (select host, {_SCORE} as score from t where round = 10) t on t.host = r.host left join (select host, {_SCORE} as score from d where round = 10) d on d.host = r.host
""",
    "op7_source_mix": f"""
with d as (select doc_id, source, cast(len({_WORDS.format("coalesce(text, '')")}) as bigint) as size, md5('0:' || doc_id) as place from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as k from d group by source),
w as (select *, [5e0, 2e0, 1e0][k % 3 + 1] as weight, source_size * 3e0 as cap, [1.5e0, 1e0, 0.5e0][k % 3 + 1] as a, [0.5e0, 1e0, 1.5e0][k % 3 + 1] as b from s),
v as (select *, (sum(source_size) over () * 1e0 - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0e0))
  / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from w),
t as (select *, least(cap, max(level) over () * weight) as target from v),
p as (select *, floor(target / source_size) as passes from t),
x as (select d.*, p.source_size, p.target, p.a, p.b, p.passes, coalesce(sum(d.size) over (partition by d.source order by place rows between unbounded preceding and 1 preceding), 0) as before
  from d join p on d.source is not distinct from p.source),
c as (select *, case when size = 0 then 0 else passes + case when before + size / 2e0 < target - passes * source_size and passes < 3 then 1 else 0 end end as copies,
  case when target > 0 then least(1e0, before / target) else 0e0 end as done from x)
select doc_id, size, source_size, target, cast(copies * size as bigint) as taken,
  case when copies > 0 then round(least(1e0, greatest(0e0, done * (a + b) / (a + sqrt(greatest(0e0, a * a + (b - a) * (done * (a + b))))))), 6) end as first_position
from c
""",
    "op6_ngram_jaccard": f"""
with recursive d as (
  select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents
), s as (
  select doc_id, unnest(list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as g
  from d
), c as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from o join c x on x.doc_id = a join c y on y.doc_id = b where 100 * o >= 90 * (x.n + y.n - o)),
e as (select a, b from l union all select b, a from l),
r(doc_id, reach) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.reach = e.a)
select r.doc_id, coalesce(max(c.n), 0) as n_shingles, min(r.reach) as component_id from r left join c on c.doc_id = r.doc_id group by r.doc_id
""",
    "op10_substring_dedup": f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
v as (select doc_id, i, md5(array_to_string(w[i:i+49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
f as (select h, min(doc_id) as least from v group by h),
g as (select distinct doc_id, unnest(range(i, i + 50)) as p from v join f using (h) where doc_id > least),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
k as (select x.doc_id, string_agg(word, ' ' order by x.p) as kept, count(*) as n from x left join g on g.doc_id = x.doc_id and g.p = x.p where g.p is null group by x.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from d left join k on k.doc_id = d.doc_id
""",
    "op11_merkle_manifest": f"""
with recursive c as (select doc_id, source, {_MERKLE_LEAF.format("text")} as leaf, {_MERKLE_LEAF.format(_LOWER.format("text"))} as lowered, {_CRC32} as crc from documents),
d as (select *, row_number() over () as r, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from c),
g(level, source, i, n, h) as (
  select 0, source, i, n, leaf from d
  union all
  select level + 1, source, i // 16, (n + 15) // 16, sha256(string_agg(h, '' order by i)) from g where n > 1 group by level, source, i // 16, n
), s as (select source, h, level as height, row_number() over (order by source nulls first) - 1 as i, count(*) over () as n from g where n = 1),
t(level, i, n, h) as (
  select 0, i, n, h from s
  union all
  select level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' order by i)) from t where n > 1 group by level, i // 16, n
), p as (
  select d.r, g.level, coalesce(string_agg(h, '' order by g.i) filter (g.i < d.i // cast(16 ** g.level as bigint)), '') as a, coalesce(string_agg(h, '' order by g.i) filter (g.i > d.i // cast(16 ** g.level as bigint)), '') as b
  from d join g on d.source is not distinct from g.source and g.n > 1 and g.i // 16 = d.i // cast(16 ** (g.level + 1) as bigint) group by d.r, g.level
  union all
  select d.r, s.height + t.level, coalesce(string_agg(t.h, '' order by t.i) filter (t.i < s.i // cast(16 ** t.level as bigint)), ''), coalesce(string_agg(t.h, '' order by t.i) filter (t.i > s.i // cast(16 ** t.level as bigint)), '')
  from d join s on d.source is not distinct from s.source join t on t.n > 1 and t.i // 16 = s.i // cast(16 ** (t.level + 1) as bigint) group by d.r, s.height, t.level
), f(r, level, h) as (
  select r, 0, case when crc % 5 = 0 then lowered else leaf end from d
  union all
  select f.r, f.level + 1, sha256(p.a || f.h || p.b) from f join p on p.r = f.r and p.level = f.level
), q as (select r, sha256(string_agg(a || b, '' order by level)) as proof, max(level) + 1 as top from p group by r)
select d.doc_id, d.leaf, s.h as subroot, t.h as root, coalesce(q.proof, sha256('')) as proof_sha256, f.h as folded_root, f.h = t.h as verified
from d join s on d.source is not distinct from s.source join (select h from t where n = 1) t on true left join q on q.r = d.r join f on f.r = d.r and f.level = coalesce(q.top, 0)
""",
    "op9_kd_topk": """
with v as (
  select vec_id, row_number() over () as row, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.row, q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.row <> c.row where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by row order by score desc, vec_id) as rank from s)
where rank <= 5
""",
}
