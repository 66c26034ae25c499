"""Queries of this subpackage over the supplied tables, with SQL twins where SQL can
express them."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, filter_audit, infill, language_id, licenses, near_dedup, ngram_join, token_counts, vector_search
from .common import read
from .decontaminate import contaminated
from .line_dedup import remove_shared_lines
from .mixing import mix
from .stages import quality_weights
from .substring_dedup import remove_repeats

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query("op1_nearest_vectors")
def op1(spark, folder):
    """The 20 nearest vectors of every 20th vector."""
    vectors = read(spark, folder, "embeddings")
    return vector_search.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op2_token_counts")
def op2(spark, folder):
    """Pre-tokens and unigram tokens of every text."""
    return token_counts.token_counts(read(spark, folder, "documents"))


@query("op3_decontaminate")
def op3(spark, folder):
    """Benchmark passages found in documents."""
    found = contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))


@query("op4_line_dedup")
def op4(spark, folder):
    """Lines that each document loses to earlier ones."""
    left = remove_shared_lines(read(spark, folder, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op5_language_id")
def op5(spark, folder):
    """Language of every text, learned from three quarters of the documents."""
    docs = read(spark, folder, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    field = language_id.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    told = docs.select("doc_id", held_out.alias("held_out"), language_id.predicted(field).alias("told"))
    return told.select("doc_id", "held_out", "told.lang_pred", "told.score")


CHAT_SQL = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(length(role) + length(regexp_replace(text, '<(\\*)\|(im_start|im_end)\|>', '<\1\\|\2|>', 'g')) + 24) as bigint) as formatted_chars
from turns group by conv_id
"""


@query("op6_chat_format", CHAT_SQL)
def op6(spark, folder):
    """Digests read back from formatted conversations."""
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


SUBSTRING_SQL = r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from docs where len(w) >= 13),
windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as k from starts),
first as (select k, min(doc_id) as least from windows group by k),
covered as (select distinct doc_id, i + j as pos from windows join first using (k), range(13) r(j) where least < doc_id),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from docs),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by pos) as text from words anti join covered using (doc_id, pos) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from docs left join kept using (doc_id)
"""


@query("op7_substring_dedup", SUBSTRING_SQL)
def op7(spark, folder):
    """Words left after passages of 13 words that earlier documents hold."""
    left = remove_repeats(read(spark, folder, "documents"), length=13)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])
    return left.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


MIX_SQL = r"""
with sized as (
    select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
        -ln((cast('0x' || md5('7:' || doc_id)[1:13] as bigint) + 0.5::double) / 4503599627370496::double)
            / coalesce(case quality when 1 then 2.0::double when 0 then 0.5::double end, 1.0::double) as key
    from documents left join labels using (doc_id)
),
sources as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (select *, list_value(3.0::double, 1.0::double, 2.0::double)[1 + (row_number() over (order by source nulls last) - 1) % 3] as weight, source_size * 2.0::double as cap from sources),
levels as (
    select *, greatest((sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
        / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following), 0) as level from ranked
),
final as (select min(cap / weight) filter (level * weight < cap) as fill from levels),
targets as (
    select source, source_size, round(case when level * weight >= cap then cap else weight * (select min_by(level, cap / weight) from levels where level * weight < cap) end, 6) as target from levels
),
budgets as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from targets),
running as (
    select s.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size as rest,
        sum(size) over (partition by s.source order by key, doc_id rows unbounded preceding) as until
    from sized s join budgets b on s.source is not distinct from b.source
)
select doc_id, size, source_size, target,
    cast((whole + case when rest > 0 and until - rest <= rest - (until - size) then 1 else 0 end) * size as bigint) as taken
from running
"""


@query("op8_source_mix", MIX_SQL)
def op8(spark, folder):
    """Words of every document in a mix of the sources."""
    mixed = mix(read(spark, folder, "documents"), quality_weights(spark, folder))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


NEAR_SQL = r"""
with recursive docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
),
shingles as (
    select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from docs
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b using (s) where a.doc_id < b.doc_id group by all),
pairs as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common.n >= 80 * (x.n + y.n - common.n)),
links as (select a, b from pairs union all select b, a from pairs),
reach(doc_id, other) as (select a, b from links union select r.doc_id, l.b from reach r join links l on l.a = r.other),
groups as (select doc_id, min(other) as least from reach group by doc_id)
select d.doc_id, coalesce(n, 0) as n_shingles, least(coalesce(g.least, d.doc_id), d.doc_id) as component_id, coalesce(g.least, d.doc_id) >= d.doc_id as kept
from docs d left join sizes using (doc_id) left join groups g using (doc_id)
"""


@query("op9_near_dedup", NEAR_SQL)
def op9(spark, folder):
    """Groups of documents alike in 80 % of their four-word shingles."""
    return near_dedup.near_duplicates(read(spark, folder, "documents"), length=4, percent=80)


LICENSE_SQL = (
    r"""
with templates(template, label, body) as (values """
    + ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(licenses.TEMPLATES))
    + r"""),
wanted as (select template, label, list_distinct(string_split(body, ' ')) as t from templates),
folded as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
words as (select doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from folded),
places as (
    select doc_id, i - 1 as pos, case when w[i] = 'mit' and w[i + 1] = 'license' then 'mit' when w[i] = 'apache' and w[i + 1] = 'license' then 'apache'
        when w[i] = 'general' and w[i + 1] = 'public' and w[i + 2] = 'license' then 'gpl' end as label
    from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words)
),
base as (select doc_id, count(*) as n, min(pos) as low, max(pos) as high, string_agg(distinct label, ',' order by label) as labels from places where label is not null group by doc_id),
lines as (select doc_id, list_distinct(regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from (select doc_id, unnest(string_split(text, chr(10))) as line from folded)),
met as (select doc_id, label, len(list_intersect(w, t)) / len(t) as share from lines, wanted where len(list_intersect(w, t)) >= ceil(round(0.8 * len(t), 9))),
best as (select doc_id, max(share) as share from met group by doc_id),
every as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from places where label is not null union all select doc_id, label from met) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_base, low as first_word, high as last_word,
    coalesce(base.labels, '') as base_labels, coalesce(every.labels, '') as labels, cast(case when n > 0 then 1 else coalesce(share, 0) end as double) as score
from words left join base using (doc_id) left join every using (doc_id) left join best using (doc_id)
"""
)


@query("op10_license_scan", LICENSE_SQL)
def op10(spark, folder):
    """License phrases and texts in every document."""
    return licenses.scan(read(spark, folder, "documents"))


INFILL_SQL = r"""
with docs as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as lines, sha256('7:' || doc_id) as h from documents
),
drawn as (select *, len(lines) as n, list_transform([1, 9, 17, 25], lambda i: cast('0x' || h[i:i + 7] as bigint)) as d from docs),
placed as (
    select *, least(d[1] % (n + 1), d[2] % (n + 1)) as low, greatest(d[1] % (n + 1), d[2] % (n + 1)) as high,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain' when d[4] % 100 < 50 then 'spm' else 'psm' end as form from drawn
),
parts as (select *, array_to_string(lines[1:low], '') as p, array_to_string(lines[low + 1:high], '') as m, array_to_string(lines[high + 1:n], '') as s from placed)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
    sha256(text) as restored_sha256
from parts
"""


@query("op11_fill_in_middle", INFILL_SQL)
def op11(spark, folder):
    """Every text cut at two line ends and put in fill-in-the-middle order."""
    made = infill.fill_in_middle(read(spark, folder, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256"))


JOIN_SQL = NEAR_SQL.split("groups as")[0].replace("80 * (", "85 * (") + """groups as (select doc_id, min(other) as least from reach group by doc_id),
texts as (select doc_id, min(doc_id) over (partition by t) as first from (select doc_id, list_sort(list(s)) as t from shingles group by doc_id)),
linked as (select a as doc_id, count(distinct y.first) as n_links from links join texts x on x.doc_id = a join texts y on y.doc_id = b where x.first <> y.first group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, least(coalesce(g.least, d.doc_id), d.doc_id) as component_id, coalesce(l.n_links, 0) as n_links
from docs d left join sizes using (doc_id) left join groups g using (doc_id) left join linked l using (doc_id)
"""


@query("op12_ngram_join", JOIN_SQL)
def op12(spark, folder):
    """Documents alike in 85 % of their four-word shingles, by a prefix-tree join."""
    return ngram_join.similar(read(spark, folder, "documents"), length=4, percent=85)


AUDIT_SQL = r"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
known as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
flags as (
    select doc_id, part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
        {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
         'D': regexp_matches(text, '[#$%&*|]'), 'E': doc_id > min(doc_id) over (partition by text)} as f
    from texts left join known using (doc_id)
),
failed as (
    select doc_id, part, good, toxic, (case when f.A then 'A' else '' end) || (case when f.B then 'B' else '' end) || (case when f.C then 'C' else '' end) || (case when f.D then 'D' else '' end) || (case when f.E then 'E' else '' end) as fails
    from flags
),
cells as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from failed group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
    select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps as (select filter_order, step, filter_order[step] as filter, filter_order[1:step - 1] as before from orders, (select unnest(range(1, 6)) as step)),
walked as (
    select part, filter_order, step, filter, n, good, toxic, fails, contains(fails, filter) as hit, translate(fails, before, '') <> fails as gone
    from steps, cells
),
summed as (
    select part, filter_order, cast(step as int) as step, filter, coalesce(sum(n) filter (not hit and not gone), 0) as kept, coalesce(sum(n) filter (hit and not gone), 0) as removed,
        coalesce(sum(n) filter (hit and gone), 0) as redundant, coalesce(sum(n) filter (fails = filter), 0) as unique_fails,
        coalesce(sum(good) filter (hit and not gone), 0) as good_lost, coalesce(sum(toxic) filter (hit and not gone), 0) as toxic_lost
    from walked group by part, filter_order, step, filter
)
select part, filter_order, step, filter, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
    cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, filter) as bigint) as shapley
from summed
"""


@query("op13_filter_audit", AUDIT_SQL)
def op13(spark, folder):
    """Five filters in all 120 orders, for every language."""
    return filter_audit.audit(filter_audit.cells(read(spark, folder, "documents"), read(spark, folder, "labels")))


@query("pipeline")
def pipeline(spark, folder):
    """Documents through all stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, folder)
