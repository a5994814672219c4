"""The numbered queries, each on its whole table."""

from __future__ import annotations

import corpus_pipeline

from . import collocations, frames, jaccard, maxent, mixing, outliers, packing, personal, secret_scan, sketches, substrings, toxicity, whitening
from .common import read_table
from .registry import QUERIES, SQL, query  # noqa: F401


@query("op1_secret_scans")
def op1(spark, folder):
    return secret_scan.digest(secret_scan.scan(read_table(spark, folder, "documents")))


@query("op2_document_fingerprints")
def op2(spark, folder):
    return sketches.neighbours(read_table(spark, folder, "documents"))


@query("op3_personal_data")
def op3(spark, folder):
    return personal.digest(personal.scan(read_table(spark, folder, "documents")))


@query("op4_best_fit_packing")
def op4(spark, folder):
    return packing.packed(read_table(spark, folder, "documents"))


@query("op5_substring_dedup")
def op5(spark, folder):
    return substrings.deduplicated(read_table(spark, folder, "documents"), with_text=False).drop("spans")


@query("op6_token_frames")
def op6(spark, folder):
    return frames.read_files(frames.write_files(read_table(spark, folder, "documents")))


@query("op7_toxicity")
def op7(spark, folder):
    return toxicity.toxicity(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query("op8_ngram_jaccard")
def op8(spark, folder):
    return jaccard.joined(read_table(spark, folder, "documents"))


@query("op9_quality_rules")
def op9(spark, folder):
    out = outliers.quality(read_table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def _level(k):
    """SQL that divides the budgets of level k - 1 among the nodes of level k."""
    names = ", ".join(f"p{i}" for i in range(k + 1))
    parent = f"partition by {', '.join(f'p{i}' for i in range(k))} order by fill, p{k}" if k else f"order by fill, p{k}"
    join = f"join b{k - 1} using ({', '.join(f'p{i}' for i in range(k))})" if k else "cross join root"
    weight = f"coalesce(map {{{', '.join(f'{chr(39)}{n}{chr(39)}: {w}' for n, w in mixing.WEIGHTS[k].items())}}}[p{k}], 1.0)" if k in mixing.WEIGHTS else "1.0"
    return f"""
n{k} as (select {names}, sum(capacity)::double supply from leaves group by all),
w{k} as (select *, {weight}::double weight, supply / {weight}::double fill from n{k} {join}),
f{k} as (select *, coalesce(sum(supply) over ({parent} rows between unbounded preceding and 1 preceding), 0) full_, sum(weight) over ({parent} rows between current row and unbounded following) rest from w{k}),
u{k} as (select *, have - full_ >= fill * rest used from f{k}),
l{k} as (select *, max(case when not used then (have - full_) / rest end) over ({parent} rows between unbounded preceding and current row) lev from u{k}),
b{k} as (select {names}, case when used then supply else least(supply, lev * weight) end have from l{k})"""


OP10_SQL = rf"""
with docs as (
  select doc_id, 'd' || (cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 4) p0, lang p1, source p2,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint n_tokens from documents),
leaves as (select p0, p1, p2, sum(n_tokens) tokens, {mixing.EPOCHS} * sum(n_tokens) capacity from docs where n_tokens > 0 group by all),
root as (select least(sum(tokens)::double, sum(capacity)::double) have from leaves),{_level(0)},{_level(1)},{_level(2)},
given as (select p0, p1, p2, tokens, floor(have + 1e-6)::bigint budget from leaves join b2 using (p0, p1, p2)),
dealt as (
  select doc_id, p0, p1, p2, epoch::int epoch, tokens, budget, n_tokens,
         (epoch * tokens + coalesce(sum(n_tokens) over (partition by p0, p1, p2, epoch order by md5('{mixing.SEED}:' || epoch || ':' || doc_id), doc_id rows between unbounded preceding and 1 preceding), 0))::bigint start
  from docs join given using (p0, p1, p2), range({mixing.EPOCHS}) e(epoch) where n_tokens > 0)
select doc_id, p0, p1, p2, epoch, start, n_tokens, least(n_tokens, budget - start)::bigint take from dealt where start < budget
"""


@query("op10_mixing_weights", OP10_SQL)
def op10(spark, folder):
    return mixing.mixed(read_table(spark, folder, "documents"), mixing.LEVELS, mixing.WEIGHTS)


@query("op11_embedding_whitening")
def op11(spark, folder):
    return whitening.whitened(read_table(spark, folder, "embeddings"))


OP12_SQL = rf"""
with recursive pieces as (
  select coalesce(lang, 'und') lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') w
  from documents),
places as (select lang, w, unnest(range(1, len(w) + 1)) i from pieces where len(w) > 0),
counts as (
  select lang, k::int k, array_to_string(w[i:i + k - 1], ' ') g, w[i:i + k - 1] p, count(*)::bigint a
  from places, range(1, {collocations.LONGEST + 1}) s(k) where i + k - 1 <= len(w) group by all having count(*) >= {collocations.LEAST}),
totals as (select lang, count(*)::bigint n from places group by lang),
cuts as (
  select c.lang, c.k, c.g, c.p, c.a, f.a l, r.a r, j, (2000000 * c.a::hugeint) // (f.a::hugeint + r.a::hugeint) score
  from (select *, unnest(range(1, k)) j from counts where k > 1) c
  join counts f on f.lang = c.lang and f.k = c.j and f.g = array_to_string(c.p[1:c.j], ' ')
  join counts r on r.lang = c.lang and r.k = c.k - c.j and r.g = array_to_string(c.p[c.j + 1:c.k], ' ')),
cand as (select * from cuts qualify row_number() over (partition by lang, g order by score, j) = 1),
inner_ as (
  select lang, array_to_string(p[s:s + z - 1], ' ') g, max(a) most
  from cand, range(1, {collocations.LONGEST}) q(s), range(2, {collocations.LONGEST}) t(z) where z < k and s + z - 1 <= k group by all),
edge as (select lang, g, p, array_to_string(p[1:3], ' ') tail, array_to_string(p[2:4], ' ') head from counts where k = {collocations.LONGEST}),
ins as (select lang, head node, min(g) e, count(*) i from edge group by all),
outs as (select lang, tail node, min(g) f, count(*) o from edge group by all),
links as (select lang, e, f from ins join outs using (lang, node) where i = 1 and o = 1),
walks as (
  select lang, g start, g cur, 1::bigint n from edge
  union all select w.lang, w.start, x.f, w.n + 1 from walks w join links x on x.lang = w.lang and x.e = w.cur and x.f <> w.start),
ahead as (select lang, start g, max(n) n from walks group by all),
behind as (select lang, cur g, max(n) n from walks group by all),
rings as (select distinct w.lang, w.start g from walks w join links x on x.lang = w.lang and x.e = w.cur and x.f = w.start),
sizes as (select e.lang, e.p, {collocations.LONGEST - 1} + case when r.g is null then a.n + b.n - 1 else a.n end words
  from edge e join ahead a using (lang, g) join behind b using (lang, g) left join rings r using (lang, g)),
held as (
  select lang, array_to_string(p[s:s + z - 1], ' ') g, max(words) path_words
  from sizes, range(1, {collocations.LONGEST}) q(s), range(2, {collocations.LONGEST + 1}) t(z) where s + z - 1 <= {collocations.LONGEST} group by all),
left_ as (select c.* from cand c left join inner_ i on i.lang = c.lang and i.g = c.g where i.most is null or {collocations.SHARE[0]} * i.most < {collocations.SHARE[1]} * c.a)
select lang, row_number() over (partition by lang order by score desc, a desc, g)::bigint rank, g phrase, a, l, r, n, score::bigint score, coalesce(path_words, k)::bigint path_words
from left_ join totals using (lang) left join held using (lang, g) qualify row_number() over (partition by lang order by score desc, a desc, g) <= {collocations.TOP}
"""


@query("op12_phrase_collocations", OP12_SQL)
def op12(spark, folder):
    return collocations.mine(read_table(spark, folder, "documents"))


@query("op13_language_model")
def op13(spark, folder):
    return maxent.scored(read_table(spark, folder, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)
