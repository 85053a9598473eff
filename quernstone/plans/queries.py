"""Relational operators as plans: each function gives SQL in a dialect.

The names in the comments are the operators of the survey's inventory.
"""

from __future__ import annotations

SALT, SEED = "quern-1", "quern-seed"


def _fraction(d, key):
    return f"cast({d.u64(d.sha(f'concat({chr(39)}{SALT}{chr(39)}, {d.nul()}, cast({key} as string))'))} as double) / 18446744073709551616.0"


def _priority(d, key):
    return d.sha(f"concat('{SEED}', {d.nul()}, cast({key} as string))")


def split_assign(d):  # SPL-1
    return f"""select doc_id, case when f < 0.9 then 'train' when f < 0.95 then 'validation' else 'test' end as split
    from (select doc_id, {_fraction(d, 'doc_id')} as f from {d.table('documents')}) x"""


def split_counts(d):  # AGG-4
    return f"""select s.split, count(x.doc_id) as n_docs from (select 'train' as split union all select 'validation' union all select 'test') s
    left join ({split_assign(d)}) x on x.split = s.split group by s.split"""


def exact_dedup_first_wins(d):  # XFN-5, WIN-1
    return f"""select doc_id, content_key, dup_rank = 1 as kept from (
      select doc_id, content_key, row_number() over (partition by content_key order by source, doc_id) as dup_rank from (
        select doc_id, source, {d.sha(d.collapse('text'))} as content_key from {d.table('documents')}) a) b"""


def source_counters(d):  # AGG-2
    return f"""select source, count(*) as n_input, count(case when kept then 1 end) as n_documents, count(case when not kept then 1 end) as n_duplicates
    from (select o.source, x.kept from ({exact_dedup_first_wins(d)}) x join {d.table('documents')} o on o.doc_id = x.doc_id) y group by source"""


def hash_priority_topk(d):  # TOP-1, TOP-2, SRC-12
    return f"""select doc_id, priority from (select doc_id, {_priority(d, 'doc_id')} as priority from {d.table('documents')}) a order by priority, doc_id limit 100"""


def selection_digest(d):  # AGG-16
    row = "concat(priority, chr(9), cast(doc_id as string))" if d.name == "spark" else "priority || chr(9) || cast(doc_id as string)"
    return f"""select count(*) as n, {d.sha(d.ordered('priority', row, 'chr(10)'))} as digest from ({hash_priority_topk(d)}) a"""


def reject_reasons(d):  # FLT-7, FLT-9: every reason, in order
    w, l = d.words("text"), d.lines("text")
    rs = [
        "case when n_words < 70 then 'too_few_words' end", "case when n_words > 180 then 'too_many_words' end",
        "case when n_lines < 8 then 'too_few_lines' end", "case when n_lines > 20 then 'too_many_lines' end",
        "case when n_distinct_lines < n_lines then 'repeated_line' end",
        "case when quotes % 2 <> 0 then 'unbalanced_quotes' end",
        "case when bigrams - distinct_bigrams > 0.2 * greatest(bigrams, 1) then 'repeated_bigrams' end",
        "case when text like '%```%' then 'code_fence' end",
    ]
    return f"""select doc_id, {d.join(d.compact(rs), "','")} as reasons, {d.size(d.compact(rs))} = 0 as accepted from (
      select doc_id, text, {d.size('w')} as n_words, {d.size('l')} as n_lines, {d.size(d.distinct('l'))} as n_distinct_lines,
        length(text) - length(replace(text, '"', '')) as quotes, {d.size(d.ngrams('w', 2))} as bigrams, {d.size(d.distinct(d.ngrams('w', 2)))} as distinct_bigrams
      from (select doc_id, text, {w} as w, {l} as l from {d.table('documents')}) a) b"""


def first_reject_reason(d):  # FLT-3, FLT-4: the first reason only
    return f"""select doc_id, case when trim(text) = '' then 'empty' when lower(text) like '%copyright%' then 'editorial_marker'
      when n > 1000 then 'over_context' else null end as reason from (select doc_id, text, {d.size(d.tokens('text'))} as n from {d.table('documents')}) a"""


def repetition_metrics(d):  # AGG-8
    return f"""select doc_id, bigrams, cast(bigrams - kinds as double) / greatest(bigrams, 1) as repetition from (
      select doc_id, {d.size(d.ngrams('w', 2))} as bigrams, {d.size(d.distinct(d.ngrams('w', 2)))} as kinds from (select doc_id, {d.words('text')} as w from {d.table('documents')}) a) b"""


def structure_metrics(d):  # AGG-9
    return f"""select doc_id, count(*) as n_lines, round(avg(n), 9) as mean_words, round(var_pop(n), 6) as var_words from (
      select doc_id, cast({d.size(d.words('l'))} as double) as n from (select doc_id, {d.explode(d.lines('text'))} as l from {d.table('documents')}) a) b group by doc_id"""


def keyword_relevance(d):  # XFN-16
    common = "array_intersect(dw, kw)" if d.name == "spark" else "list_intersect(dw, kw)"
    kw = f"(select label, sort_array(collect_set(word)) as kw from (select 'a' as label, 'the' as word union all select 'a', 'der' union all select 'a', 'que' union all select 'a', 'license') z group by label)" if d.name == "spark" else "(select 'a' as label, ['the', 'der', 'que', 'license'] as kw)"
    return f"""select doc_id, cast({d.size(common)} as double) / {d.size('kw')} as relevance from (select doc_id, {d.distinct(d.words('text'))} as dw from {d.table('documents')}) a cross join {kw} k"""


def stanza_counts(d):  # XFN-12
    parts = r"split(text, '\\n{{2,}}')" if d.name == "spark" else r"string_split_regex(text, '\n{2,}')"
    n = d.each(d.keep(parts, "p", "trim(p) <> ''"), "p", d.size(d.lines("p")))
    shown = f"array_join(transform({n}, x -> cast(x as string)), ',')" if d.name == "spark" else f"array_to_string({n}, ',')"
    return f"select doc_id, {shown} as pattern from {d.table('documents')}"


def ngram_overlap(d):  # AGG-10, JOIN-13
    one = []
    for n in range(1, 13):
        grams = lambda t, k: f"select distinct {k}, g from (select {k}, {d.explode(d.ngrams('w', n))} as g from (select {k}, {d.words('text')} as w from {d.table(t)}) a) b"  # noqa: B023, E731
        one.append(f"""select item_id, {n} as n, count(*) as n_grams, count(r.g) as n_found from ({grams('benchmark', 'item_id')}) c
          left join (select distinct g from ({grams('documents', 'doc_id')}) x) r on r.g = c.g group by item_id""")
    return f"select item_id, n, n_grams, n_found, cast(n_found as double) / n_grams as rate from ({' union all '.join(one)}) y"


def decontaminate_12gram(d):  # DEC-3, JOIN-13
    grams = lambda t, k: f"select distinct {k}, g from (select {k}, {d.explode(d.ngrams('w', 12))} as g from (select {k}, {d.words('text')} as w from {d.table(t)}) a) b"
    return f"""select o.doc_id, count(x.g) as n_shared, count(x.g) > 0 as contaminated from {d.table('documents')} o
      left join (select a.doc_id, a.g from ({grams('documents', 'doc_id')}) a join (select distinct g from ({grams('benchmark', 'item_id')}) q) b on a.g = b.g) x on x.doc_id = o.doc_id group by o.doc_id"""


def _chat(d):
    return f"select conv_id, {d.ordered('turn', 'substr(role, 1, 1)', chr(39) * 2)} as roles, count(*) as n from {d.table('conversations')} group by conv_id"


def conversation_grammar(d):  # FLT-5
    return f"select conv_id, roles, n >= 2 and {d.match('roles', '^s?(ua)+$')} as valid from ({_chat(d)}) a"


def conversation_hash_dedup(d):  # XFN-6, WIN-3, WIN-4
    msg = "concat(role, chr(9), text)" if d.name == "spark" else "role || chr(9) || text"
    return f"""select conv_id, h, first_value(conv_id) over (partition by h order by conv_id) as duplicate_of from (
      select conv_id, {d.sha(d.ordered('turn', msg, 'chr(10)'))} as h from {d.table('conversations')} group by conv_id) a"""


def duplicate_assistant(d):  # FLT-6
    return f"""select conv_id, count(*) as n_answers, count(distinct text) < count(*) as repeated from {d.table('conversations')} where role = 'assistant' group by conv_id"""


def line_runs(d):  # AGG-1: gaps and islands within a conversation
    return f"""select conv_id, role, cast(run as bigint) as run, min(turn) as first_turn, count(*) as n_lines, {d.sha(d.ordered('turn', 'text', 'chr(10)'))} as joined from (
      select *, sum(case when role = prev then 0 else 1 end) over (partition by conv_id order by turn rows unbounded preceding) as run from (
        select conv_id, turn, role, text, lag(role) over (partition by conv_id order by turn) as prev from {d.table('conversations')}) a) b group by conv_id, role, run"""


def protected_antijoin(d):  # JOIN-7, SET-4
    return f"select doc_id from {d.table('documents')} o left anti join {d.table('benchmark')} b on lower(o.text) = lower(b.text)" if d.name == "spark" else "select doc_id from documents o where not exists (select 1 from benchmark b where lower(o.text) = lower(b.text))"


def conditional_examples(d):  # JOIN-1, JOIN-2, PRJ-7
    eid = d.sha("concat(cast(doc_id as string), chr(9), cast(conv_id as string), chr(9), coalesce(thought, ''))")
    base = f"""select o.doc_id, c.conv_id, l.quality from {d.table('documents')} o join {d.table('labels')} l on l.doc_id = o.doc_id
      join {d.table('conversations')} c on c.conv_id = o.doc_id and c.turn = 0"""
    return f"""select substring({eid}, 1, 24) as example_id, doc_id, conv_id, thought from (
      select doc_id, conv_id, cast(null as string) as thought from ({base}) a union all select doc_id, conv_id, cast(quality as string) from ({base}) b) x"""


def referential_audit(d):  # JOIN-19, SET-2, SET-5, GOV-7
    return f"""select count(*) as n_labels, count(o.doc_id) as n_known, count(*) - count(o.doc_id) as n_missing, count(distinct l.doc_id) = count(*) as ids_unique
      from {d.table('labels')} l left join {d.table('documents')} o on o.doc_id = l.doc_id"""


def exact_cover(d):  # SET-5, JOIN-14
    return f"""select count(case when a.doc_id is null then 1 end) as surplus, count(case when b.doc_id is null then 1 end) as missing
      from (select distinct doc_id from {d.table('documents')}) a full outer join (select distinct doc_id from {d.table('labels')}) b on a.doc_id = b.doc_id"""


def chunk_offsets(d):  # PCK-3: width 65, one token of overlap
    n = d.size(d.tokens("text"))
    return f"""select doc_id, i * 64 as start, least(65, n - i * 64) as length from (
      select doc_id, n, {d.explode(d.seq('0', d.div('n - 2', '64')))} as i from (select doc_id, {n} as n from {d.table('documents')}) a where n >= 2) b"""


def stride_rows(d):  # PCK-1, WIN-9: width 65, stride 64 over the concatenated corpus of a source
    return f"""select source, cast(greatest(0, {d.div('sum(n) - 1', '64')}) as bigint) as n_rows, cast(sum(n) as bigint) as n_tokens from (
      select source, {d.size(d.tokens('text'))} as n from {d.table('documents')}) a group by source"""


def stride_spans(d):  # PCK-1: which rows hold each document's tokens
    return f"""select source, doc_id, before as first_token, {d.div('greatest(before - 1, 0)', '64')} as first_row, {d.div('before + n - 1', '64')} as last_row from (
      select source, doc_id, n, cast(coalesce(sum(n) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as before from (
        select source, doc_id, {d.size(d.tokens('text'))} as n from {d.table('documents')}) a) b where n > 0"""


def objective_stats(d):  # AGG-3
    return f"""select lang as objective, count(*) as n, cast(sum(n) as bigint) as tokens, cast(sum(n) as double) / sum(sum(n)) over () as ratio from (
      select lang, greatest({d.size(d.tokens('text'))} - 1, 0) as n from {d.table('documents')}) a group by lang"""


def fair_schedule(d):  # STM-2, WIN-10: exact integer cross products for weights de:1 en:3 es:1 fr:2
    w = "case lang when 'en' then 3 when 'fr' then 2 else 1 end"
    return f"""select doc_id, lang, row_number() over (order by due, lang, doc_id) as step from (
      select doc_id, lang, {d.cap(f"coalesce(sum(n) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0) * {d.div('6', w)}")} as due from (
        select doc_id, lang, {d.size(d.tokens('text'))} as n from {d.table('documents')}) a) b"""


def exposure_plan(d):  # STM-4
    return f"""select min(step) as steps, cast(min(total) as bigint) as tokens from (select step, sum(n) over (order by step rows unbounded preceding) as total from (
      select f.step, {d.size(d.tokens('o.text'))} as n from ({fair_schedule(d)}) f join {d.table('documents')} o on o.doc_id = f.doc_id) a) b where total >= 100000"""


def curriculum_cyclic(d):  # TOP-8: hard to easy, rotated by the epoch
    return f"""select epoch, doc_id, (rn - 1 - epoch + n) % n as place from (
      select doc_id, row_number() over (order by n_chars desc, doc_id) as rn, count(*) over () as n from {d.table('documents')}) a
      cross join (select 0 as epoch union all select 1 union all select 2) e"""


def length_histogram(d):  # AGG-15
    return f"""select bin, count(*) as n from (select case when n <= 16 then 0 when n <= 64 then 1 when n <= 256 then 2 when n <= 1024 then 3 when n <= 4096 then 4 else 5 end as bin
      from (select {d.size(d.tokens('text'))} as n from {d.table('documents')}) a) b group by bin"""


def count_sketch(d):  # AGG-15, XFN-23
    h = d.u28(d.sha("word"))
    return f"""select bucket, cast(sum(n * sign) as bigint) as total from (select n, v % 256 as bucket, 1 - 2 * ({d.div('v', '256')} % 2) as sign from (
      select {h} as v, n from (select word, count(*) as n from (select {d.explode(d.words('text'))} as word from {d.table('documents')}) a group by word) b) c) e group by bucket"""


def cost_null_sum(d):  # AGG-12: unknown is not zero
    return f"""select o_orderpriority as role, case when count(v) = count(*) then round(sum(v), 2) end as total, count(*) - count(v) as n_unknown from (
      select o_orderpriority, case when o_orderkey % 5003 = 7 then null else o_totalprice end as v from {d.table('orders')}) a group by o_orderpriority"""


def break_even(d):  # AGG-12
    return f"""select s_nationkey, case when saving > 0 then greatest(1, cast(floor(cost / saving) as bigint) + 1) end as runs from (
      select s_nationkey, round(max(s_acctbal), 2) as cost, round(min(s_acctbal), 2) as saving from {d.table('supplier')} group by s_nationkey) a"""


def reconcile(d):  # AGG-13
    return f"""select o.o_orderkey, abs(o.o_totalprice - coalesce(s.parts, 0)) <= 1e-9 * greatest(abs(o.o_totalprice), abs(coalesce(s.parts, 0))) as agrees from {d.table('orders')} o
      left join (select l_orderkey, sum(l_extendedprice) as parts from {d.table('lineitem')} group by l_orderkey) s on s.l_orderkey = o.o_orderkey"""


def weighted_loss(d):  # AGG-14
    return f"""select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) as loss, round(exp(least(sum(l_discount * l_quantity) / sum(l_quantity), 80)), 9) as perplexity from {d.table('lineitem')} group by l_returnflag"""


def blind_assign(d):  # PLN-5
    h = d.u28(d.sha(f"concat('{SEED}', {d.nul()}, cast(item_id as string))"))
    return f"select item_id, case when {h} % 2 = 0 then 'A' else 'B' end as side from {d.table('benchmark')}"


def criterion_tally(d):  # AGG-11
    picks = " union all ".join(f"select '{c}' as criterion, {e} as choice from {d.table('labels')}" for c, e in (("quality", "case quality when 1 then 'a' else 'b' end"), ("toxic", "case toxic when 1 then 'b' when 0 then 'a' else 'tie' end")))
    return f"select criterion, count(case when choice = 'a' then 1 end) as wins_a, count(case when choice = 'b' then 1 end) as wins_b, count(case when choice = 'tie' then 1 end) as ties from ({picks}) p group by criterion"


def eval_grid(d):  # PLN-4: the one Cartesian product
    rid = d.sha("concat(cast(item_id as string), chr(9), cast(seed as string))")
    return f"select substring({rid}, 1, 24) as request_id, item_id, seed from {d.table('benchmark')} cross join (select 11 as seed union all select 12 union all select 13) s"


def pending_requests(d):  # JOIN-9, JOIN-10
    return f"select g.request_id, g.item_id, g.seed from ({eval_grid(d)}) g left join (select request_id from ({eval_grid(d)}) z where seed = 12) e on e.request_id = g.request_id where e.request_id is null"


def json_props(d):  # XFN-22
    return f"select event_id, {d.json('props', 'k')} as k from {d.table('events')}"


def token_estimate(d):  # XFN-21
    return f"select doc_id, {d.div(d.bytes('text') + ' + 2', '3')} + 256 as estimate from {d.table('documents')}"


def snapshot_turning(d):  # differences of neighbours
    return f"""select user_id, event_id, round(next1 - value, 6) as velocity, round(next2 - 2 * next1 + value, 6) as acceleration from (
      select user_id, event_id, value, lead(value, 1) over w as next1, lead(value, 2) over w as next2 from {d.table('events')} window w as (partition by user_id order by ts, event_id)) a where next2 is not null"""


def prefix_rollup(d):  # AGG-17
    return f"""select scope, name, count(*) as n, round(sum(p_retailprice), 2) as total from (
      select 1 as scope, substr(p_type, 1, 3) as name, p_retailprice from {d.table('part')} union all select 2, p_type, p_retailprice from {d.table('part')} union all select 0, '', p_retailprice from {d.table('part')}) a group by scope, name"""


def lane_assignment(d):  # TOP-4
    return f"select doc_id, case when doc_id % 6 < 3 then 'a' when doc_id % 6 < 5 then 'b' else 'c' end as lane from {d.table('documents')}"


def rights_gate(d):  # GOV-1
    return f"""select source, rights, count(*) as n, rights <> 'denied' as passes from (select source, case when source = 'src3' then 'denied' when source = 'src5' then 'synthetic' else 'unknown' end as rights from {d.table('documents')}) a group by source, rights"""


def markdown_counts(d):  # XFN-14, AGG-20
    return f"""select doc_id, length(text) - length(replace(text, '*', '')) as stars, {d.sha("replace(text, '*', '')")} as clean_hash from {d.table('documents')}"""


def tumbling_windows(d):  # event time; beyond the inventory
    hour = "date_trunc('hour', ts)"
    return f"select {hour} as hour, event_type, count(*) as n, round(sum(value), 4) as total from {d.table('events')} group by {hour}, event_type"


ALL = [f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")]
