"""Queries of the thirteen operators over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import collocations, divergence, idstore, knn, language, linededup, lmscore, lzprint, mixing, neardup, packing, tokencount, toxicity
from folioforge.llm.common import read, remainder

REMAINDER = "crc32(cast(coalesce(cast(doc_id as string), '') as binary))"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = language.fit(docs.where(~held_out))
    out = language.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(read(spark, sf_dir, "documents"), f"{REMAINDER} % 10 <> 0")


def op3_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.edits(read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(read(spark, sf_dir, "embeddings"))


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of a bounded sample of the labelled rows of docs, without those whose remainder mod 5 is 0."""
    return toxicity.sample(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(labelled_documents(docs, read(spark, sf_dir, "labels")))
    out = toxicity.predict(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_report(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "shards")


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = idstore.write_store(read(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), end=0)
    return idstore.read_report(spark, folder, idstore.root(spark, folder))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), least=3, most=200)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read(spark, sf_dir, "documents"), least=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"), least=100, most=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_lm_score, op3_lz_fingerprint, op4_token_counts, op5_exact_topk, op6_toxicity, op7_mix_sources, op8_minhash_neardup, op9_token_store, op10_pack, op11_source_divergence, op12_line_dedup, op13_collocations)}


_LETTERS = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP5_SQL = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, cast(list_dot_product(q.e, d.e) as bigint) as score from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5"""

def _permuted_sql(rows: str, index: str, n: str, which: str, into: str, inverse: bool = False) -> str:
    """The rows of a query with the column ``into``, the permuted index: a subquery for each round."""
    rows = f"select *, {index} as x from ({rows})"
    for a, b in reversed(mixing.round_constants()) if inverse else mixing.round_constants():
        rows = f"select *, ({mixing.round_key(a, b, n, which)} + {n} - x) % {n} as y from ({rows})"
        rows = f"select * exclude (x, y), case when {mixing.round_bit(a, b, 'greatest(x, y)', which, '//')} then y else x end as x from ({rows})"
    return f"select * exclude (x), x as {into} from ({rows})"


_B = mixing.BLOCK
OP7_SQL = f"""with d as (select doc_id, source, coalesce(len({_WORDS.format("text")}), 0) as size from documents),
n as (select source, sum(size) as source_size from d group by source),
k as (select *, row_number() over (order by source nulls last) - 1 as k from n),
w as (select *, [5, 2, 1][k % 3 + 1] as weight, 2 * source_size as cap from k),
l as (select *, sum(cap) over (order by cap / weight, k) - cap as capped, sum(weight) over () - sum(weight) over (order by cap / weight, k) + weight as free from w),
v as (select *, (cast(1.5 as double) * sum(source_size) over () - capped) / free as level from l),
c as (select arg_min(level, capped) as common from v where level * weight <= cap),
t as (select source, k, source_size, case when common is null or weight * common > cap then cast(cap as double) else weight * common end as target from v, c),
a as (select *, cast(ceil(source_size / {_B}) as bigint) as blocks, least(cast(round(target) as bigint), 2 * cast(source_size as bigint)) as want from t),
f as (select *, coalesce(want // nullif(cast(source_size as bigint), 0), 0) as full_passes, blocks * {_B} - cast(source_size as bigint) as gap from a),
r as (select *, want - full_passes * cast(source_size as bigint) as rest from f),
i as ({_permuted_sql("select * from r", "(blocks - 1)", "greatest(blocks, 1)", "(k * 2 + full_passes)", "short", inverse=True)}),
o as (select *, full_passes * blocks + (rest + {_B - 1}) // {_B} + cast(short < (rest + {_B - 1}) // {_B} and (rest + {_B - 1}) // {_B} * {_B} - gap < rest as bigint) as n_slots from i),
h as (select greatest(1, cast((sum(n_slots) + {mixing.SHARD_SLOTS - 1}) // {mixing.SHARD_SLOTS} as bigint)) as shards from o),
j as (select *, unnest(range(n_slots)) as j from o where n_slots > 0),
q as (select j.*, {mixing.shard_of("k", "j", "h.shards")} as shard from j, h),
z as (select *, row_number() over (partition by k order by shard) - 1 as slot from q),
y0 as (select source, k, blocks, full_passes, rest, short as short_at, gap, shard, slot // blocks as pass, slot % blocks as place from z),
y as ({_permuted_sql("select * from y0", "place", "blocks", "(k * 2 + pass)", "block")}),
m as (select source, block, shard, case when pass < full_passes then len else least(len, rest - place * {_B} + case when short_at < place then gap else 0 end) end as words
  from (select *, {_B} - case when block = blocks - 1 then gap else 0 end as len from y)),
p as (select *, sum(size) over (partition by source order by doc_id, size rows unbounded preceding) - size as start from d),
b as (select doc_id, source, start, size, unnest(range(cast(start // {_B} as bigint), cast((start + size - 1) // {_B} + 1 as bigint))) as block from p where size > 0),
u as (select b.doc_id, m.shard, least(start + size, b.block * {_B} + words) - greatest(start, b.block * {_B}) as words from b join m on b.block = m.block and b.source is not distinct from m.source),
g as (select doc_id, sum(words) as taken, count(distinct shard) as shards from u where words > 0 group by doc_id)
select p.doc_id, cast(p.size as bigint) as size, cast(source_size as bigint) as source_size, target, cast(coalesce(taken, 0) as bigint) as taken, coalesce(shards, 0) as shards
from p join t on p.source is not distinct from t.source left join g on g.doc_id = p.doc_id"""

OP8_SQL = f"""with recursive w as (select doc_id, {_WORDS.format(_LETTERS.format("text"))} as w from documents),
s as (select doc_id, case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) when len(w) = 1 then w else [] end as s from w),
n as (select doc_id, len(s) as n from s), u as (select doc_id, unnest(s) as x from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as n_common from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * n_common >= 80 * (x.n + y.n - n_common)),
m as (select a, b from e union all select b, a from e),
r(doc_id, reached) as (select doc_id, doc_id from n union select r.doc_id, m.b from r join m on m.a = r.reached)
select n.doc_id, cast(n.n as bigint) as n_shingles, min(reached) as component_id, n.doc_id = min(reached) as kept from n join r using (doc_id) group by n.doc_id, n.n"""


OP11_SQL = rf"""with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select doc_id, lang, source, unnest(regexp_extract_all({_LETTERS.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as n from t group by all),
k as (select lang, term, count(*) as whole from t group by all having count(distinct doc_id) >= 3),
v as (select lang, count(*) as v, sum(whole) as words from k group by lang),
s as (select lang, source, sum(n) as n from c semi join k on c.lang = k.lang and c.term = k.term group by all),
g as (select d.lang, d.source, coalesce(s.n, 0) + coalesce(v.v, 0) as total, coalesce(v.words, 0) + coalesce(v.v, 0) as whole_total
  from (select distinct lang, source from d) d left join s on d.lang = s.lang and d.source = s.source left join v on d.lang = v.lang),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)::hugeint) // total as p, 1 + (1000000000 * (k.whole + 1)::hugeint) // whole_total as q
  from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select lang, source, 'term', term, (((p - q) * (p - q)) // q)::bigint from p where n > 0 and p > q)
select lang, source, part, item, value, cast(rank as integer) as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r) where part = 'pair' or rank <= 200"""

OP12_SQL = rf"""with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as spot from d),
k as (select doc_id, line, spot, {_LETTERS.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
m as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10),
x as (select k.doc_id, k.line, k.spot, m.key is not null as gone from k left join m on k.key = m.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by spot) filter (not gone), '')) as kept_sha256 from x group by doc_id"""

OP13_SQL = rf"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LETTERS.format("coalesce(text, '')")}, '[.,;:!?
-
]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^ 	]+') as w from p),
t as (select lang, sum(len(w))::hugeint as n from w group by lang),
s as (select lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) as g from w),
c as (select lang, g, count(*)::hugeint as a from s group by all having count(*) >= 100),
k as (select lang, g, a, unnest(range(1, len(g))) as k from c),
x as (select k.lang, k.g, k.a, k.k, l.a as l, r.a as r, t.n, (1000 * k.a * t.n) // (l.a * r.a) as score
  from k join c l on l.lang = k.lang and l.g = k.g[1:k.k] join c r on r.lang = k.lang and r.g = k.g[k.k + 1:len(k.g)] join t on t.lang = k.lang),
b as (select * from x qualify row_number() over (partition by lang, g order by score, k) = 1),
u as (select lang, unnest([g[1:len(g) - 1], g[2:len(g)]]) as g, a from c where len(g) > 2),
h as (select lang, g, max(a) as around from u group by all),
o as (select b.lang, array_to_string(b.g, ' ') as phrase, b.a, b.l, b.r, b.n, b.score from b left join h on h.lang = b.lang and h.g = b.g where h.around is null or 100 * h.around < 100 * b.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from o
qualify rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express; the others are tested against brute force."""
    return {"op5_exact_topk": OP5_SQL, "op7_mix_sources": OP7_SQL, "op8_minhash_neardup": OP8_SQL, "op11_source_divergence": OP11_SQL, "op12_line_dedup": OP12_SQL, "op13_collocations": OP13_SQL}
