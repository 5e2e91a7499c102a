"""Registered queries of the corpus operators, and their SQL where there is one."""

from __future__ import annotations

from .bagminhash import op10_bagminhash_near_duplicates
from .collocations import op12_perfect_hash_collocations
from .cover_tree import op6_dual_cover_tree
from .language import op8_hyperdimensional_language
from .lexical_search import op11_threshold_search
from .mixing import op5_pfair_mixing
from .packing import op2_power_of_two_packing
from .pii import op3_bootstrapped_pii, planted_card_findings
from .quality import op9_rule_ensemble_quality
from .simhash import op4_simhash
from .substrings import op13_de_bruijn_substrings
from .token_counts import op7_token_counts
from .toxicity import op1_noisy_channel_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_noisy_channel_toxicity,
        op2_power_of_two_packing,
        op3_bootstrapped_pii,
        op4_simhash,
        op5_pfair_mixing,
        op6_dual_cover_tree,
        op7_token_counts,
        op8_hyperdimensional_language,
        op9_rule_ensemble_quality,
        op10_bagminhash_near_duplicates,
        op11_threshold_search,
        op12_perfect_hash_collocations,
        op13_de_bruijn_substrings,
        planted_card_findings,
    )
}

#: Components are those of the vectors that take part; the SQL scores all pairs of a query and a candidate.
TOP_PRODUCTS = """
with v as (
    select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
    from embeddings
    where embedding is not null and vec_id is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), q as (
    select min(r) as r, vec_id, e from v where vec_id % 50 = 0 group by vec_id, e
), scored as (
    select q.r, q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
    from q join v c on q.r <> c.r and len(q.e) = len(c.e)
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from scored)
where rank <= 5
"""

#: All pairs that share a shingle, by the overlap of their bags; classes by reachability.
NEAR_CLASSES = r"""
with recursive w as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as ws from documents
), shingles as (
    select doc_id, s, count(*) as n from (
        select doc_id, unnest(case when len(ws) = 0 then ['no words: ' || t] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as s from w
    ) group by all
), sizes as (
    select doc_id, sum(n) as size from shingles group by 1
), pairs as (
    select a.doc_id as a, b.doc_id as b, sum(least(a.n, b.n)) as shared from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all
), links as (
    select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where shared >= 0.8 * (x.size + y.size - shared)
), both_ways as (
    select a, b from links union all select b, a from links
), reached as (
    select a, b from both_ways union select r.a, e.b from reached r join both_ways e on e.a = r.b
)
select doc_id, least(doc_id, coalesce(min(b), doc_id)) as class_id from documents left join reached on a = doc_id group by doc_id
"""

#: Earliest deadline first, slot by slot; sources are held in lists in the order of their names.
SCHEDULE = """
with recursive d as (
    select doc_id, coalesce(source, '') as source, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as h from documents
), counts as (
    select source, count(*) as n from d group by 1
), ranked as (
    select doc_id, source, row_number() over (partition by source order by h % parts, h, doc_id) - 1 as r from d, (select greatest(1, cast(ceil(max(n) / 250) as bigint)) as parts from counts)
), plan as (
    select list(source order by source) as names, list(cast(ceil(n / 8) as bigint) order by source) as blocks, list(greatest(1, cast(round(10000 * pow(n, 0.7) / total) as bigint)) order by source) as w from counts, (select sum(pow(n, 0.7)) as total from counts)
), steps as (
    select cast(-1 as bigint) as slot, cast(-1 as bigint) as phase, cast(0 as bigint) as start, true as over_, blocks as left_, list_transform(blocks, lambda x: cast(0 as bigint)) as done, 0 as pick, cast(0 as bigint) as block, cast(0 as bigint) as release, cast(0 as bigint) as deadline from plan
    union all
    select slot, phase, start, left_[pick] = 1, list_transform(left_, lambda x, i: x - (i = pick)::bigint), list_transform(done, lambda x, i: x + (i = pick)::bigint), pick, blocks[pick] - left_[pick], start + done[pick] * period // w[pick], start + (done[pick] + 1) * period // w[pick] + ((done[pick] + 1) * period % w[pick] > 0)::bigint from (
        select *, list_sort(list_filter(list_transform(w, lambda a, i: case when left_[i] > 0 and done[i] * period // a <= slot - start then [(done[i] + 1) * period // a + ((done[i] + 1) * period % a > 0)::bigint, i] end), lambda k: k is not null))[1][2] as pick from (
            select slot + 1 as slot, phase + over_::bigint as phase, case when over_ then slot + 1 else start end as start, left_, case when over_ then list_transform(done, lambda x: cast(0 as bigint)) else done end as done, names, blocks, w,
                list_sum(list_transform(w, lambda a, i: case when left_[i] > 0 then a else 0 end))::bigint as period from steps, plan where list_sum(left_) > 0))
)
select doc_id, source, phase, block, release, deadline, slot, r % 8 as place, row_number() over (order by slot, r % 8) - 1 as position
from ranked join (select *, names[pick] as source from steps, plan where slot >= 0) using (source) where block = r // 8
"""

_EXPRESSIONS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_found = "\n    union all ".join(f"select doc_id, {k} as rank, '{kind}' as kind, regexp_extract_all(x, '{e}') as ms, regexp_split_to_array(x, '{e}') as gaps from t" for k, (kind, e) in enumerate(_EXPRESSIONS.items()))
#: The base spans, and as all spans the base spans alone: around them the words of the given tables are random, so the
#: method finds no pattern to trust there; tests hold what it adds to planted tables.
BASE_SPANS = f"""
with t as (
    select doc_id, coalesce(text, '') as x from documents
), found as (
    {_found}
), placed as (
    select doc_id, rank, kind, ms[i] as v, regexp_replace(ms[i], '[^0-9]', '', 'g') as digits, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) as start
    from (select *, unnest(range(1, len(ms) + 1)) as i from found)
), held as (
    select *, kind || ':' || start || ':' || (start + length(v)) as span from placed where case kind when 'email' then true when 'phone' then length(digits) between 8 and 15
        when 'ip' then list_bool_and(list_transform(string_split(v, '.'), lambda p: coalesce(try_cast(p as hugeint) <= 255, false)))
        else length(digits) between 16 and 19 and list_sum(list_transform(range(0, length(digits)), lambda i: case when i % 2 = 0 then substr(reverse(digits), i + 1, 1)::int when substr(reverse(digits), i + 1, 1)::int > 4 then 2 * substr(reverse(digits), i + 1, 1)::int - 9 else 2 * substr(reverse(digits), i + 1, 1)::int end)) % 10 = 0 end
), whole as (
    select doc_id, count(*) filter (where kind = 'email') as n_email, count(*) filter (where kind = 'ip') as n_ip, count(*) filter (where kind = 'card') as n_card, count(*) filter (where kind = 'phone') as n_phone, string_agg(span, ',' order by rank, start) as spans from held group by 1
)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from documents left join whole using (doc_id)
"""

_digit = lambda k: f"cast(substr(p, {15 - k}, 1) as integer)"
_luhn = " + ".join(f"(case when {_digit(k)} > 4 then 2 * {_digit(k)} - 9 else 2 * {_digit(k)} end)" if k % 2 == 0 else _digit(k) for k in range(15))
#: The base spans of the planted texts, and the numbers that no expression finds, which stand where they were planted.
PLANTED_SPANS = BASE_SPANS[: BASE_SPANS.index("), whole as (")].replace(
    "select doc_id, coalesce(text, '') as x from documents",
    f"""select doc_id, 'charge card ' || p || cast(((10 - ({_luhn}) % 10) % 10 + case when doc_id % 4 = 0 then 1 else 0 end) % 10 as varchar) || ' expires soon. ' || coalesce(text, '') as x
    from (select *, lpad(cast(doc_id * 104729 + 400000000000 as varchar), 15, '4') as p from documents)""",
) + """), whole as (
    select doc_id, rank, start, span, 1 as base from held union all select doc_id, 2, 12, 'card:12:28', 0 from documents where doc_id % 4 = 0
)
select doc_id, cast(sum(base) as bigint) as n_base, string_agg(span, ',' order by rank, start) as spans from whole group by doc_id
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All documents that share a term with an item, scored whole.
RANKED = rf"""
with d as (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
), postings as (
    select doc_id, term, count(*) as tf from d group by all
), lengths as (
    select doc_id, count(*) as n from d group by 1
), totals as (
    select count(*) as docs, cast(sum(n) as bigint) as all_ from lengths
), weights as (
    select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::double)) as bigint) as w from postings, totals group by term, docs
), items as (
    select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), scored as (
    select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // all_)))) as bigint) as score
    from items join postings using (term) join weights using (term) join lengths using (doc_id), totals group by 1, 2
)
select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 50
"""

#: All phrases of one to three words counted, cuts in 128 bits.
COLLOCATIONS = rf"""
with pieces as (
    select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as ws from documents
), numbered as (
    select lang, row_number() over () as piece, ws from pieces
), words as (
    select lang, piece, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as w1 from numbered
), rows_ as (
    select lang, w1, lead(w1, 1) over (partition by piece order by i) as w2, lead(w1, 2) over (partition by piece order by i) as w3 from words
), f1 as (
    select lang, w1, count(*) as f from rows_ group by all
), f2 as (
    select lang, w1, w2, count(*) as f from rows_ where w2 is not null group by all
), f3 as (
    select lang, w1, w2, w3, count(*) as f from rows_ where w3 is not null group by all having count(*) >= 10
), n as (
    select lang, count(*) as n from words group by 1
), cuts as (
    select c.lang, c.w1, c.w2, null as w3, c.f as a, 1 as cut, x.f as l, y.f as r from f2 c join f1 x on x.lang = c.lang and x.w1 = c.w1 join f1 y on y.lang = c.lang and y.w1 = c.w2 where c.f >= 10
    union all select c.lang, c.w1, c.w2, c.w3, c.f, 1, x.f, y.f from f3 c join f1 x on x.lang = c.lang and x.w1 = c.w1 join f2 y on y.lang = c.lang and y.w1 = c.w2 and y.w2 = c.w3
    union all select c.lang, c.w1, c.w2, c.w3, c.f, 2, x.f, y.f from f3 c join f2 x on x.lang = c.lang and x.w1 = c.w1 and x.w2 = c.w2 join f1 y on y.lang = c.lang and y.w1 = c.w3
), scored as (
    select *, concat_ws(' ', w1, w2, w3) as phrase, cast((1000000::hugeint * a * a) // (l::hugeint * r) as bigint) as score from cuts
), lowest as (
    select * from (select *, row_number() over (partition by lang, phrase order by score, cut) as best from scored) where best = 1
), outer_ as (
    select lang, w1, w2, max(f) as most from (select lang, w1, w2, f from f3 union all select lang, w2, w3, f from f3) group by all
), kept as (
    select lowest.* from lowest left join outer_ o on lowest.w3 is null and o.lang = lowest.lang and o.w1 = lowest.w1 and o.w2 = lowest.w2 where most is null or 100 * most < 50 * a
)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join n using (lang) where rank <= 2000
"""

#: Windows by their words, with the smallest document of each.
SUBSTRINGS = r"""
with w as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), windows as (
    select doc_id, i, array_to_string(ws[i:i + 12], ' ') as k from (select *, unnest(range(1, len(ws) - 11)) as i from w)
), firsts as (
    select k, min(doc_id) as first from windows group by 1
), gone as (
    select distinct doc_id, unnest(range(i, i + 13)) as pos from windows join firsts using (k) where first < doc_id
), words as (
    select doc_id, unnest(range(1, len(ws) + 1)) as pos, unnest(ws) as word from w
), kept as (
    select doc_id, count(*) as n_kept, string_agg(word, ' ' order by pos) as text from words anti join gone using (doc_id, pos) group by 1
)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n_kept, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (doc_id)
"""

ORACLES: dict[str, str] = {
    "op3_bootstrapped_pii": BASE_SPANS, "op5_pfair_mixing": SCHEDULE, "op6_dual_cover_tree": TOP_PRODUCTS, "op10_bagminhash_near_duplicates": NEAR_CLASSES,
    "op11_threshold_search": RANKED, "op12_perfect_hash_collocations": COLLOCATIONS, "op13_de_bruijn_substrings": SUBSTRINGS,
    "planted_card_findings": PLANTED_SPANS,
}
