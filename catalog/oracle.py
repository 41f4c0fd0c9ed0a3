"""SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from catalog.reads import COLUMNS_SQL, READS_SQL
from readloom.functions.dna import rank_mask

K = 21

KMERS = READS_SQL + f""",
windows as (select read_id, seq, unnest(range(len(seq) - {K - 1})) as i from reads where len(seq) >= {K}),
cut as (select read_id, len(seq) as n, i, substr(seq, i + 1, {K}) as f,
               substr(seq, i + {K // 2 + 1}, 1) in ('G', 'T') as rc from windows),
kmers as (
  select case when rc then reverse(translate(f, 'ACGT', 'TGCA')) else f end as kmer, read_id,
         cast(case when rc then n - {K} - i else i end as integer) as pos, rc
  from cut where not contains(f, 'N'))"""

COUNTS = KMERS + """,
counts as materialized (select kmer, count(*) as n from kmers group by kmer)"""

SPECTRUM = COUNTS + """,
spectrum as (select n as multiplicity, count(*) as n_kmers from counts group by n)"""

PEAK = SPECTRUM + """,
beside as (
  select *, row_number() over (order by multiplicity) - 1 as idx,
         lag(n_kmers) over (order by multiplicity) as lo, lead(n_kmers) over (order by multiplicity) as hi
  from spectrum),
valley as (select min(idx) as idx, min(multiplicity) as m from beside where lo >= n_kmers and n_kmers <= hi),
peaks as (
  select b.multiplicity, b.n_kmers from beside b, valley v
  where b.idx >= v.idx and lo <= n_kmers and n_kmers >= hi
  order by n_kmers desc, multiplicity limit 1),
marks as (
  select v.idx as valley_index, v.m as valley_multiplicity, p.multiplicity as kmer_cov, p.n_kmers as peak_kmers,
         (select cast(sum(multiplicity * n_kmers) as bigint) from spectrum) as n_occurrences
  from valley v left join peaks p on true)"""

TOTALS = """,
totals as (
  select cast(sum(len(seq)) as bigint) as bases, cast(sum(len(seq) - 20) as bigint) as kmers_all from reads),
chars as (select unnest(string_split(qual, '')) as c from reads),
errs as (
  select sum(n * pow(10.0, (33 - ascii(c)) / 10.0)) as expected_errors
  from (select c, count(*) as n from chars group by c))"""

BANDED = PEAK + """,
band as (select kmer, n from counts, marks where n > 1 and n < 20 * kmer_cov),
banded as (select k.* from kmers k semi join band b on k.kmer = b.kmer),
ordered as materialized (
  select *, row_number() over (partition by kmer order by pos desc, read_id, rc) - 1 as ord from banded)"""

RANK = (
    "xor(cast('0b' || replace(replace(replace(replace(kmer, 'A', '00'), 'C', '01'), 'G', '10'), 'T', '11') as bigint), "
    f"cast({rank_mask(K)} as bigint))"
)

PAIRS = BANDED + f""",
steps as (
  select kmer, lag(read_id) over w as a, read_id as b, lag(rc) over w as rc_a, rc as rc_b,
         lag(pos) over w - pos as "offset"
  from ordered window w as (partition by kmer order by ord)),
consecutive as materialized (select *, {RANK} as rank from steps where a is not null),
pairs as (
  select a, b, rc_a, rc_b, "offset", count(*) as n_kmers, arg_min(kmer, rank) as kmer
  from consecutive group by a, b, rc_a, rc_b, "offset")"""

LINKS = PAIRS + f""",
ranked as materialized (select distinct read_id, {RANK} as rank from kmers),
lowest_here as materialized (select a, b, min(rank) as rank from consecutive group by a, b),
lower as materialized (
  select distinct l.a, l.b from lowest_here l
  join ranked x on x.read_id = l.a and x.rank < l.rank join ranked y on y.read_id = l.b and y.rank = x.rank),
lowest as materialized (select * from lowest_here l anti join lower w on w.a = l.a and w.b = l.b),
links as materialized (
  select distinct c.a, c.b, c.kmer, c.rank from consecutive c
  join lowest l on c.a = l.a and c.b = l.b and c.rank = l.rank)"""

GROUPS = LINKS + """,
groups as (select * from ordered semi join links using (kmer))"""

ORIENTED = """,
oriented as (
  select p.a, p.b, p.rc_a, p.rc_b, p."offset",
         case when p.rc_a then reverse(translate(x.seq, 'ACGT', 'TGCA')) else x.seq end as sa,
         case when p.rc_b then reverse(translate(y.seq, 'ACGT', 'TGCA')) else y.seq end as sb
  from pairs p join reads x on x.read_id = p.a join reads y on y.read_id = p.b),
measured as (
  select *, least(len(sa) - greatest("offset", 0), len(sb) - greatest(-"offset", 0)) as overlap from oriented),
laid as (
  select a, b, rc_a, rc_b, "offset", overlap, j,
         substr(sa, greatest("offset", 0) + j + 1, 1) = substr(sb, greatest(-"offset", 0) + j + 1, 1) as eq
  from (select *, unnest(range(overlap)) as j from measured)),
scored as (
  select a, b, rc_a, rc_b, "offset", cast(overlap as integer) as overlap,
         cast(count_if(eq) as integer) as matches, cast(2 * count_if(eq) - overlap as integer) as score,
         count_if(eq and j < 5) as early
  from laid group by a, b, rc_a, rc_b, "offset", overlap
  having count_if(eq) / overlap >= 0.9 and count_if(eq) >= 21)"""

SEGMENTS = LINKS + """,
text_pairs as (
  select l.a || '-' || l.b as pair_id, x.seq as template, y.seq as pattern
  from links l join reads x on x.read_id = l.a join reads y on y.read_id = l.b),
tw as (select pair_id, t, substr(template, t + 1, 21) as w
       from (select *, unnest(range(len(template) - 20)) as t from text_pairs)),
pw as (select pair_id, p, substr(pattern, p + 1, 21) as w
       from (select *, unnest(range(len(pattern) - 20)) as p from text_pairs)),
hits as (select pair_id, t - p as d, p from tw join pw using (pair_id, w)),
islands as (select *, p - row_number() over (partition by pair_id, d order by p) as g from hits),
runs as (select pair_id, d, min(p) as p_start, max(p) + 21 as p_end from islands group by pair_id, d, g),
segments as (
  select pair_id, cast(p_start + d as integer) as t_start, cast(p_start as integer) as p_start,
         cast(p_end as integer) as p_end
  from runs r where not exists (
    select 1 from runs o where o.pair_id = r.pair_id and o.d <> r.d
      and o.p_start <= r.p_start and o.p_end >= r.p_end))"""


DOCUMENT_SEGMENTS = """
doc_words as (select doc_id, text, string_split(text, ' ') as words from documents where text is not null),
doc_keys as materialized (
  select doc_id, list_min(list_transform(range(1, greatest(len(words) - 4, 1) + 1),
         lambda i: md5(array_to_string(words[i:i + 4], ' ')))) as key from doc_words),
text_pairs as materialized (
  select k.a || '-' || k.b as pair_id, x.text as template, y.text as pattern
  from (select min(doc_id) over (partition by key) as a, doc_id as b from doc_keys) k
  join documents x on x.doc_id = k.a join documents y on y.doc_id = k.b where k.a < k.b),
tw as (select pair_id, t, substr(template, t + 1, 50) as w
       from (select *, unnest(range(len(template) - 49)) as t from text_pairs)),
pw as (select pair_id, p, substr(pattern, p + 1, 50) as w
       from (select *, unnest(range(len(pattern) - 49)) as p from text_pairs)),
hits as (select pair_id, t - p as d, p from tw join pw using (pair_id, w)),
islands as (select *, p - row_number() over (partition by pair_id, d order by p) as g from hits),
runs as materialized (select pair_id, d, min(p) as p_start, max(p) + 50 as p_end from islands group by pair_id, d, g),
segments as materialized (
  select pair_id, cast(p_start + d as integer) as t_start, cast(p_start as integer) as p_start,
         cast(p_end as integer) as p_end
  from runs r where not exists (
    select 1 from runs o where o.pair_id = r.pair_id and o.d <> r.d
      and o.p_start <= r.p_start and o.p_end >= r.p_end)),
shifts as (
  select pair_id, arg_min(d, -v * 10000000 + d) as diagonal, max(v) as votes
  from (select pair_id, t_start - p_start as d, cast(sum(p_end - p_start) as bigint) as v from segments group by all)
  group by pair_id)"""


def profile(cells: str, by: str, name: str) -> str:
    """CTEs <name>_votes and <name>_cols over a table of (by, base, qual)."""
    return f""",
{name}_votes as (
  select {by}, base, count(*) as n, cast(case when base = 'N' then 0 else sum(qual) end as bigint) as sum_q,
         sum(pow(10.0, -qual / 10.0)) as sum_e
  from {cells} group by {by}, base),
{name}_cols as (
  select {by}, arg_max(base, sum_q * 1000 - ascii(base)) as ref, arg_max(n, sum_q * 1000 - ascii(base)) as ref_n,
         arg_max(base, case when base <> 'N' then sum_q * 1000 - ascii(base) end) as "right",
         cast(sum(n) as bigint) as depth, sum(sum_e) / sum(n) as e
  from {name}_votes group by {by})"""


def quantile(inputs: str, name: str) -> str:
    """CTE <name>(n, p, q) over distinct inputs (n, p): binomial terms by the logarithm of the gamma function."""
    return f""",
{name}_in as (
  select *, sqrt(n * p * (1 - p)) * 12 + 20 as reach, n * (1 - p) as mean
  from (select distinct cast(n as bigint) as n, p from {inputs} where n >= 1 and p > 0 and p < 1)),
{name}_steps as (
  select n, p, unnest(range(greatest(0, cast(floor(mean - reach) as bigint)),
                            least(n, cast(ceil(mean + reach) as bigint)) + 1)) as j from {name}_in),
{name}_terms as (
  select n, p, j, exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(1 - p) + (n - j) * ln(p)) as t
  from {name}_steps),
{name}_sums as (
  select *, sum(t) over (partition by n, p order by j) as cdf from {name}_terms),
{name} as (
  select n, p, coalesce(round(arg_min(j - (cdf - 0.9999) / t, j) filter (j >= 1 and cdf > 0.9999), 9), 0.0) as q
  from {name}_sums group by n, p)"""


def tested(cells: str, by: str, name: str, cap: str, margin: str) -> str:
    """CTE <name>: error test of every base of every column."""
    on = " and ".join(f"v.{c.strip()} = c.{c.strip()}" for c in by.split(","))
    return (
        profile(cells, by, name)
        + f""",
{name}_pre as (
  select v.*, c.ref, c."right", c.depth, c.e, v.n + least(c.ref_n, {cap}) as qn
  from {name}_votes v join {name}_cols c on {on}),
{name}_args as (select qn as n, 1 - e as p from {name}_pre where base <> ref)"""
        + quantile(f"{name}_args", f"{name}_q")
        + f""",
{name} as (
  select t.*, base <> ref and sum_q <= {margin} * (-10 * log10(e)) + coalesce(z.q, 0.0) * (-10 * log10(e)) as is_error
  from {name}_pre t left join {name}_q z on z.n = t.qn and z.p = 1 - t.e)"""
    )


ALIGNED = GROUPS + """,
aligned as (
  select g.kmer, g.ord, g.read_id, -g.pos as start, case when g.rc then -1 else 1 end as strand, len(r.seq) as n,
         r.address, g.rc,
         case when g.rc then reverse(translate(r.seq, 'ACGT', 'TGCA')) else r.seq end as bases,
         case when g.rc then reverse(r.qual) else r.qual end as quals
  from groups g join reads r using (read_id)),
acells as materialized (
  select kmer, ord, read_id, strand, start + i as col, substr(bases, i + 1, 1) as base,
         ascii(substr(quals, i + 1, 1)) - 33 as qual,
         (address + case when rc then n - 1 - i else i end) * 2048 as node
  from (select *, unnest(range(n)) as i from aligned)),
acounts as materialized (select kmer, col, base, count(*) as n from acells group by kmer, col, base),
acons as (select kmer, col, arg_max(base, n * 1000 - ascii(base)) as base from acounts group by kmer, col)"""

IDENTITY = ALIGNED + """,
identity as (
  select a.kmer, a.ord, a.read_id, cast(sum(case when a.base = c.base then qual else 0 end) as bigint) as matched,
         cast(sum(qual) as bigint) as total
  from acells a join acons c on a.kmer = c.kmer and a.col = c.col group by a.kmer, a.ord, a.read_id),
gcells as materialized (
  select a.* from acells a semi join (select kmer, ord from identity where matched >= 0.9 * total) i
  on a.kmer = i.kmer and a.ord = i.ord)"""

POLY = (
    IDENTITY
    + tested("gcells", "kmer, col", "ct", "(select kmer_cov from marks)", "0.0")
    + """,
poly as (
  select kmer, col, string_agg(base, '' order by base) as real from ct where not is_error
  group by kmer, col having count(*) > 1)"""
)

PRINTS = POLY + """,
gr as (select distinct kmer, ord, read_id from gcells),
marked as (
  select r.kmer, r.ord, r.read_id, p.col, case when contains(p.real, g.base) then g.base else ' ' end as b,
         coalesce(g.qual, 40) as q
  from gr r left join poly p on p.kmer = r.kmer
  left join gcells g on g.kmer = r.kmer and g.ord = r.ord and g.col = p.col),
prints as (
  select kmer, ord, read_id, coalesce(string_agg(b, '' order by col) filter (col is not null), '') as print,
         coalesce(string_agg(cast(q as varchar), ',' order by col) filter (col is not null), '') as print_q
  from marked group by kmer, ord, read_id)"""

def _shared_quality(equal: str, j: str, i: str) -> str:
    """Lesser qualities summed over the columns in which two prints both have a letter, the same or not."""
    a, b = f"letters[{j}][c]", f"letters[{i}][c]"
    return (
        f"list_sum(list_transform(range(1, len(letters[{j}]) + 1), lambda c: case when {a} <> ' ' and {b} <> ' ' "
        f"and {a} {equal} {b} then least(quals[{j}][c], quals[{i}][c]) else 0 end))"
    )


def _nearest(others: str, most: int) -> str:
    """Number of the print most like print i that contradicts it by at most ``most``; the earlier one on a tie."""
    return (
        f"list_min(list_transform(list_filter({others}, lambda j: solid[j] and {_shared_quality('<>', 'j', 'i')} <= {most}), "
        f"lambda j: {{'l': -{_shared_quality('=', 'j', 'i')}, 'j': j}})).j"
    )


# Greedy clusters in the order of the first reads: a step of the recursion places one print of each alignment.
PRINT_CLUSTERS = PRINTS + f""",
printed as (
  select kmer, ord, print, cast(string_split(print_q, ',') as bigint[]) as q from prints where print <> ''),
print_sums as (
  select kmer, print, j, cast(sum(q[j]) as bigint) as s
  from (select *, unnest(range(1, len(print) + 1)) as j from printed) group by kmer, print, j),
print_list as (
  select kmer, print, first, q, list_min(q) > 60 as solid, row_number() over (partition by kmer order by first) as i
  from (select kmer, print, list(s order by j) as q from print_sums group by kmer, print)
  join (select kmer, print, min(ord) as first from printed group by kmer, print) using (kmer, print)),
placed_prints as (
  with recursive steps(kmer, i, n, letters, quals, solid, host) as (
    select kmer, cast(1 as bigint), count(*), list(print order by i), list(q order by i), list(solid order by i), list(i order by i)
    from print_list group by kmer
    union all
    select kmer, i + 1, n,
           case when f is null then letters else list_transform(letters, lambda x, j: case when j <> f then x else
             array_to_string(list_transform(range(1, len(x) + 1), lambda c: case when x[c] = ' ' then letters[i][c] else x[c] end), '') end) end,
           case when f is null then quals else list_transform(quals, lambda x, j: case when j <> f then x else
             list_transform(x, lambda y, c: y + quals[i][c]) end) end,
           solid,
           case when f is null then host else list_transform(host, lambda x, j: case when j = i then f else x end) end
    from (select *, case when solid[i] then {_nearest("range(1, i)", 0)} end as f from steps where i <= n))
  select * from steps where i = n + 1),
print_hosts as materialized (
  select kmer, i, case when solid[i] then host[i] else coalesce({_nearest("range(1, n + 1)", 60)}, i) end as h
  from (select kmer, n, letters, quals, solid, host, unnest(range(1, n + 1)) as i from placed_prints)),
print_ends as (
  with recursive ends(kmer, i, h) as (
    select * from print_hosts
    union
    select e.kmer, e.i, p.h from ends e join print_hosts p on p.kmer = e.kmer and p.i = e.h)
  select kmer, i, min(h) as h from ends e
  where exists (select 1 from print_hosts p where p.kmer = e.kmer and p.i = e.h and p.h = p.i) group by kmer, i),
print_clusters as (
  select l.kmer, l.print, t.first as cluster
  from print_list l join print_ends e on e.kmer = l.kmer and e.i = l.i join print_list t on t.kmer = l.kmer and t.i = e.h)"""

CLIQUES = PRINTS + f""",
labels0 as (select kmer, ord, min(ord) over (partition by kmer, print) as cluster from prints),
ccells as (
  select g.*, l.cluster, {RANK.replace("kmer", "g.kmer")} as rank
  from gcells g join labels0 l on g.kmer = l.kmer and g.ord = l.ord),
prior as (
  select *, lag(read_id) over (partition by kmer, cluster, col order by ord) as prev from ccells),
prior_pairs as (select distinct rank, prev as a, read_id as b from prior where prev is not null),
prior_low as (
  select p.rank, p.a, p.b, min(x.rank) as low
  from prior_pairs p join ranked x on x.read_id = p.a join ranked y on y.read_id = p.b and y.rank = x.rank
  group by p.rank, p.a, p.b),
joined as (
  select c.* from prior c left join prior_low l on l.rank = c.rank and l.a = c.prev and l.b = c.read_id
  where c.prev is null or l.low = c.rank),
cliques as materialized (
  select * from (select *, count(*) over (partition by kmer, cluster, col) as size from joined) where size > 1)"""

EDGES = CLIQUES + """,
centre as (
  select kmer, cluster, col, min(node * 2 + case when strand < 0 then 1 else 0 end) as c
  from cliques group by kmer, cluster, col),
edges as materialized (
  select u, v, max(s) as s from (
    select m.node as u, c.c // 2 as v, m.strand * case when c.c % 2 = 1 then -1 else 1 end as s
    from cliques m join centre c on m.kmer = c.kmer and m.cluster = c.cluster and m.col = c.col)
  where u <> v group by u, v)"""


def labels(edges: str, name: str) -> str:
    """CTE <name>(node, rep, s): least label over the signed double cover."""
    return f""",
{name}_cover as (
  select u * 2 as x, v * 2 + case when s < 0 then 1 else 0 end as y from {edges}
  union select u * 2 + 1, v * 2 + case when s < 0 then 0 else 1 end from {edges}),
{name}_both as materialized (select x, y from {name}_cover union select y, x from {name}_cover),
{name}_rec as (
  with recursive r(x, l) using key (x) as (
    select x, min(least(x, y)) from {name}_both group by x
    union
    select n.y, n.l
    from (select b.y as y, min(r.l) as l from r join {name}_both b on b.x = r.x group by b.y) n
    join recurring.r o on o.x = n.y where n.l < o.l)
  select * from r),
{name} as (
  select x // 2 as node, l // 2 as rep, case when l % 2 = 1 then -1 else 1 end as s from {name}_rec where x % 2 = 0)"""


MEMBERS = EDGES + labels("edges", "lab") + """,
calls as (
  select distinct node, case when strand < 0 then translate(base, 'ACGT', 'TGCA') else base end as base, qual
  from cliques),
members as (
  select rep, s, l.node // 2048 as address, cast(l.node % 2048 as integer) as gap,
         case when s < 0 then translate(base, 'ACGT', 'TGCA') else base end as base, qual
  from lab l join calls c on l.node = c.node)"""

CORRECTIONS = (
    MEMBERS
    + tested("members", "rep", "fx", "(select 2 * kmer_cov from marks)", "1.0")
    + """,
corrections as (
  select m.address, m.gap,
         case when m.s < 0 then translate(f."right", 'ACGT', 'TGCA') else f."right" end as base, m.qual
  from members m join fx f on m.rep = f.rep and m.base = f.base
  where f.is_error and f."right" is not null)"""
)

FIXED = CORRECTIONS + """,
fixes as (
  select address, gap, base, qual from corrections
  union all select address + 3, 0, '-', 5 from reads where rec_offset % 1792 = 0
  union all select address + 5, g, case g when 1 then 'A' else 'C' end, 6 + g
            from reads, (values (1), (2)) v(g) where rec_offset % 2816 = 0),
per_base as (
  select address, max(base) filter (gap = 0) as swap,
         string_agg(base, '' order by gap) filter (gap > 0 and base <> '-') as extra,
         string_agg(chr(qual + 33), '' order by gap) filter (gap > 0 and base <> '-') as extra_q
  from fixes group by address),
plain_bases as (
  select read_id, address + i as address, i, substr(seq, i + 1, 1) as b, substr(qual, i + 1, 1) as c
  from (select *, unnest(range(len(seq))) as i from reads)),
fixed as (
  select p.read_id,
         string_agg(case when swap = '-' then '' else coalesce(swap, b) end || coalesce(extra, ''), '' order by i) as seq,
         string_agg(case when swap = '-' then '' else c end || coalesce(extra_q, ''), '' order by i) as qual
  from plain_bases p left join per_base f on f.address = p.address group by p.read_id)"""

SUPPLY = """
supply as (
  select distinct l_partkey * 2 as u, l_suppkey * 2 + 1 as v,
         case when l_linenumber % 2 = 0 then -1 else 1 end as s from lineitem)"""


def star_step(edges: str, flip: str) -> str:
    return f"""{edges},
near as (
  select e.u, e.v, e.s, m.c // 2 as m, case when m.c % 2 = 1 then -1 else 1 end as sm
  from {flip} e join (select u, min(v * 2 + case when s < 0 then 1 else 0 end) as c from {flip} group by u) m
  on e.u = m.u)"""


BOTH_WAYS = SUPPLY + """,
sym as (select u, v, s from supply union all select v, u, s from supply)"""
DOWNWARD = SUPPLY + """,
down as (select greatest(u, v) as u, least(u, v) as v, s from supply)"""

PAIRED = READS_SQL + f""",
mate_pairs as (
  select x.read_id, x.seq as seq1, y.seq as seq2
  from reads x join reads y on x.seq_offset = y.seq_offset where x.file_id = 0 and y.file_id = 1),
mate_text as (select read_id, seq1 as s, false as rc from mate_pairs
              union all select read_id, seq2, true from mate_pairs),
kmers as (
  select substr(s, p + 1, {K}) as kmer, read_id, cast(p as integer) as pos, rc
  from (select *, unnest(range(len(s) - {K - 1})) as p from mate_text)
  where not contains(substr(s, p + 1, {K}), 'N'))""" + PAIRS[len(KMERS):] + """,
ends as (
  select p.a, p.b, p.rc_a, p.rc_b, p."offset",
         case when p.rc_a then x.seq2 else x.seq1 end as a1, case when p.rc_a then x.seq1 else x.seq2 end as a2,
         case when p.rc_b then y.seq2 else y.seq1 end as b1, case when p.rc_b then y.seq1 else y.seq2 end as b2
  from pairs p join mate_pairs x on x.read_id = p.a join mate_pairs y on y.read_id = p.b),
end1 as (
  select *, least(len(a1) - greatest("offset", 0), len(b1) - greatest(-"offset", 0)) as n1 from ends),
hit1 as (
  select *, list_sum(list_transform(range(n1), lambda j: case when
         a1[greatest("offset", 0) + j + 1] = b1[greatest(-"offset", 0) + j + 1] then 1 else 0 end)) as m1
  from end1 where n1 > 0),
good1 as (select *, 2 * m1 - n1 as s1 from hit1 where m1 / n1 >= 0.9 and m1 >= 21),
tries as (select *, unnest(range(1 - len(b2), len(a2))) as y from good1),
end2 as (select *, least(len(a2) - greatest(y, 0), len(b2) - greatest(-y, 0)) as n2 from tries),
first2 as (
  select * from end2 where n2 < 5 or (
    (a2[greatest(y, 0) + 1] = b2[greatest(-y, 0) + 1])::int + (a2[greatest(y, 0) + 2] = b2[greatest(-y, 0) + 2])::int
    + (a2[greatest(y, 0) + 3] = b2[greatest(-y, 0) + 3])::int + (a2[greatest(y, 0) + 4] = b2[greatest(-y, 0) + 4])::int
    + (a2[greatest(y, 0) + 5] = b2[greatest(-y, 0) + 5])::int >= 4)),
hit2 as (
  select *, list_sum(list_transform(range(n2), lambda j: case when
         a2[greatest(y, 0) + j + 1] = b2[greatest(-y, 0) + j + 1] then 1 else 0 end)) as m2
  from first2),
laid2 as (
  select a, b, rc_a, rc_b, "offset", y, s1 + 2 * m2 - n2 as score from hit2 where m2 / n2 >= 0.9 and m2 >= 21),
placed_best as (
  select a, b, rc_a, rc_b, "offset", cast(arg_min(y, -score * 1000 + y) as integer) as y,
         cast(max(score) as integer) as score
  from laid2 group by a, b, rc_a, rc_b, "offset")"""

PAIRED_CLIQUES = PAIRED + f""",
mate_ranks as materialized (select distinct read_id * 2 + rc::int as m, {RANK} as rank from kmers),
mate_steps as (select kmer, rank, a * 2 + rc_a::int as ma, b * 2 + rc_b::int as mb from consecutive),
mate_low as (
  select ma, mb, min(x.rank) as low from (select distinct ma, mb from mate_steps)
  join mate_ranks x on x.m = ma join mate_ranks y on y.m = mb and y.rank = x.rank group by ma, mb),
kept as (select distinct kmer from mate_steps join mate_low using (ma, mb) where low = rank),
chain as (
  select o.kmer, o.ord, o.read_id as b, o.rc as rc_b, lag(o.read_id) over w as a, lag(o.rc) over w as rc_a,
         lag(o.pos) over w - o.pos as "offset"
  from ordered o semi join kept on kept.kmer = o.kmer window w as (partition by o.kmer order by o.ord)),
runs as (
  select c.*, p.y, sum(case when p.y is null then 1 else 0 end) over (partition by c.kmer order by c.ord) as aln
  from chain c left join placed_best p
    on p.a = c.a and p.b = c.b and p.rc_a = c.rc_a and p.rc_b = c.rc_b and p."offset" = c."offset"),
laid as (
  select kmer, aln, ord, b as pair, rc_b as rc, count(*) over (partition by kmer, aln) as size,
         sum(case when y is null then 0 else "offset" end) over (partition by kmer, aln order by ord) as off1,
         sum(coalesce(y, 0)) over (partition by kmer, aln order by ord) as off2
  from runs),
lay as materialized (
  select kmer, {RANK} as krank, aln, ord, pair, pair * 2 + rc::int as m, v.e, case when (v.e = 2) = rc then 0 else 1 end as file_id,
         case when v.e = 1 then off1 else off2 end as off,
         case when (v.e = 2) = rc then seq1 else seq2 end as bases
  from laid join mate_pairs on read_id = pair, (values (1), (2)) v(e) where size > 1),
lower_ranks as materialized (
  select kmer, aln, ord, r.rank from lay join mate_ranks r on r.m = lay.m where e = 1 and r.rank < krank),
redundant as (
  select distinct i.kmer, i.aln, i.ord as i, j.ord as j
  from lower_ranks i join lower_ranks j on i.kmer = j.kmer and i.aln = j.aln and i.rank = j.rank and i.ord < j.ord),
spans as (
  select r.kmer, r.aln, r.j, e, off as first, off + len(bases) as past
  from redundant r join lay l on l.kmer = r.kmer and l.aln = r.aln and l.ord = r.i),
pcells as (
  select * from (select *, off + i as col from (select *, unnest(range(len(bases))) as i from lay)) c
  where not exists (select 1 from spans s where s.kmer = c.kmer and s.aln = c.aln and s.j = c.ord and s.e = c.e
                    and s.first <= c.col and c.col < s.past)),
pmembers as (select *, count(*) over (partition by kmer, aln, e, col) as size from pcells)"""

SCORE_COLUMNS = 'a, b, rc_a, rc_b, "offset", overlap, matches, score'


def _sql(ctes: str, final: str) -> str:
    return f"with {ctes.strip()}\n{final}"


# A base of quality q is wrong with e = 10^(-q/10) and then adds q: one base after the other is folded into the
# distribution of the sum. A sum is within the quantile if less than its mass lies below the sum.
EXACT_TEST = COLUMNS_SQL + """,
exact_bases as (
  select col, base, count(*) as n, cast(sum(case when base <> 'N' then qual else 0 end) as bigint) as sum_q
  from genome_columns group by col, base),
exact_dist as materialized (
  select col, list_reduce(list_concat([[cast(1.0 as double)]], list(x)), lambda d, x: list_transform(
           range(1, len(d) + cast(x[1] as bigint) + 1), lambda t: coalesce(d[t], 0.0) * (1 - x[2])
           + case when t > x[1] then d[t - cast(x[1] as bigint)] * x[2] else 0.0 end)) as d
  from (select col, [cast(qual as double), pow(10.0, -qual / 10.0)] as x from genome_columns where base <> 'N' and qual > 0)
  group by col),
exact_runs as (
  select *, cast(sum(sum_q) over (partition by col order by sum_q, base) as bigint) as running,
         cast(sum(sum_q) over (partition by col) as bigint) as total from exact_bases),
exact_test as (
  select r.col, base, n, sum_q, case when coalesce(list_sum(d[1:total]), 0) >= 0.9999
         then coalesce(list_sum(d[1:running]), 0) < 0.9999 else sum_q = 0 end as is_error
  from exact_runs r left join exact_dist e on e.col = r.col)"""

ORACLE = {
    "reverse_complement": _sql(
        READS_SQL, "select read_id, reverse(translate(seq, 'ACGT', 'TGCA')) as rc_seq from reads"
    ),
    "kmers": _sql(KMERS, "select kmer, read_id, pos, rc from kmers"),
    "canonical_kmer_counts": _sql(COUNTS, "select kmer, n from counts"),
    "kmer_spectrum": _sql(SPECTRUM, "select multiplicity, n_kmers from spectrum"),
    "spectrum_valley_peak": _sql(PEAK, "select * from marks"),
    "dataset_stats": _sql(
        PEAK + TOTALS,
        """select m.*, bases, kmers_all as kmers, round(expected_errors, 6) as expected_errors,
       round(expected_errors / bases, 6) as error_rate,
       round(kmer_cov / pow(1 - expected_errors / bases, 21) * bases / kmers_all, 6) as base_coverage,
       round(bases / (kmer_cov / pow(1 - expected_errors / bases, 21) * bases / kmers_all), 6) as genome_size
from marks m, totals, errs""",
    ),
    "phred_bases": _sql(
        READS_SQL,
        """select read_id, count(*) as n_bases, min(seq_offset + i) as first_pos, cast(sum(q) as bigint) as sum_q,
       round(sum(pow(10.0, -q / 10.0)), 6) as expected_errors
from (select read_id, seq_offset, i, ascii(substr(qual, i + 1, 1)) - 33 as q
      from (select *, unnest(range(len(seq))) as i from reads)) group by read_id""",
    ),
    "kmer_group_sizes": _sql(BANDED, "select kmer, n from band"),
    "group_reads_ordered": _sql(BANDED, "select kmer, read_id, pos, rc, cast(ord as integer) as ord from ordered"),
    "nonredundant_groups": _sql(GROUPS, "select kmer, read_id, pos, rc, cast(ord as integer) as ord from groups"),
    "overlap_pairs": _sql(PAIRS, 'select a, b, rc_a, rc_b, "offset", n_kmers, kmer from pairs'),
    "min_common_kmer": _sql(LINKS, "select a, b, kmer from links"),
    "overlap_scores": _sql(PAIRS + ORIENTED, f"select {SCORE_COLUMNS} from scored"),
    "overlap_scores_early": _sql(
        PAIRS + ORIENTED, f"select {SCORE_COLUMNS} from scored where early >= 4 or overlap < 5"
    ),
    "exact_segments": _sql(SEGMENTS, "select * from segments"),
    "document_segments": _sql(DOCUMENT_SEGMENTS, "select * from segments"),
    "document_shifts": _sql(
        DOCUMENT_SEGMENTS,
        """select p.pair_id, cast(coalesce(max(p_end - p_start), 0) as integer) as longest,
       coalesce(any_value(diagonal), 0) as diagonal, coalesce(any_value(votes), 0) as votes
from text_pairs p left join segments s on s.pair_id = p.pair_id left join shifts h on h.pair_id = p.pair_id
group by p.pair_id""",
    ),
    "diagonal_vote": _sql(
        SEGMENTS,
        """select pair_id, cast(arg_min(d, (-v) * 1000 + d) as integer) as diagonal, cast(max(v) as bigint) as votes
from (select pair_id, t_start - p_start as d, sum(p_end - p_start) as v from segments group by all) group by pair_id""",
    ),
    "longest_match": _sql(
        SEGMENTS,
        """select p.pair_id, coalesce(arg_min(t_start - p_start, (p_start - p_end) * 1000 + t_start - p_start), 0) as diagonal,
       coalesce(max(p_end - p_start), 0) as len
from text_pairs p left join segments s on s.pair_id = p.pair_id group by p.pair_id""",
    ),
    "column_votes": _sql(
        COLUMNS_SQL + profile("genome_columns", "col", "gc"), "select col, base, n, sum_q from gc_votes"
    ),
    "column_reference_base": _sql(COLUMNS_SQL + profile("genome_columns", "col", "gc"), "select col, ref from gc_cols"),
    "binomial_quantile": _sql(
        COLUMNS_SQL
        + """,
per_column as (select col, count(*) as n, 1 - avg(pow(10.0, -qual / 10.0)) as p from genome_columns group by col)"""
        + quantile("per_column", "bq"),
        "select c.col, c.n, floor(q.q * 1e6 + 0.3337) / 1e6 as quantile from per_column c join bq q on c.n = q.n and c.p = q.p",
    ),
    "column_error_test": _sql(
        COLUMNS_SQL + tested("genome_columns", "col", "gt", "c.ref_n", "0.0"),
        "select col, base, n, sum_q, ref, is_error from gt",
    ),
    "weighted_consensus": """with votes as (
  select user_id, event_type, cast(sum(cast(round(value * 100) as bigint)) as bigint) as w from events group by all),
best as (select *, row_number() over (partition by user_id order by w desc, event_type) as r from votes)
select user_id, event_type, w as weight from best where r = 1""",
    "consensus_sequence": _sql(
        ALIGNED, "select kmer, string_agg(base, '' order by col) as consensus from acons where base <> '-' group by kmer"
    ),
    "pileup": _sql(
        ALIGNED,
        """select kmer, cast(col as integer) as col, base, count(*) as n,
       cast(case when base = 'N' then 0 else sum(qual) end as bigint) as sum_q from acells group by kmer, col, base""",
    ),
    "read_identity": _sql(
        IDENTITY, "select kmer, cast(ord as integer) as ord, read_id, matched, total from identity"
    ),
    "polymorphic_columns": _sql(POLY, "select kmer, cast(col as integer) as col, real from poly"),
    "read_fingerprints": _sql(
        PRINTS, "select kmer, cast(ord as integer) as ord, read_id, print, print_q from prints"
    ),
    "column_cliques": _sql(
        CLIQUES,
        """select kmer, cast(cluster as integer) as cluster, cast(col as integer) as col, cast(ord as integer) as ord,
       node, strand from cliques""",
    ),
    "clique_edges": _sql(EDGES, "select u, v, s from edges"),
    "large_star_once": _sql(
        star_step(BOTH_WAYS, "sym"),
        """select v as u, least(u, m) as v, max(case when u < m then s else s * sm end) as s
from near where v > u group by 1, 2""",
    ),
    "small_star_once": _sql(
        star_step(DOWNWARD, "down"),
        """select case when v = m then u else v end as u, m as v, max(case when v = m then sm else s * sm end) as s
from near group by 1, 2""",
    ),
    "components": _sql(
        SUPPLY + ", plain as (select distinct u, v, 1 as s from supply)" + labels("plain", "lab"),
        "select node, rep from lab",
    ),
    "sign_conflicts": _sql(
        LINKS
        + """,
strand_edges as (
  select distinct c.a as u, c.b as v, case when c.rc_a = c.rc_b then 1 else -1 end as s
  from consecutive c join links l on c.a = l.a and c.b = l.b and c.kmer = l.kmer),
planted_edges as (
  select * from strand_edges union select u, v, -s from strand_edges where u % 7936 = 16)"""
        + labels("planted_edges", "lab"),
        """select min(l // 2) as rep, x // 2 as node from lab_rec group by x // 2 having min(l) = max(l)""",
    ),
    "signed_components": _sql(
        LINKS
        + """,
strand_edges as (
  select distinct c.a as u, c.b as v, case when c.rc_a = c.rc_b then 1 else -1 end as s
  from consecutive c join links l on c.a = l.a and c.b = l.b and c.kmer = l.kmer)"""
        + labels("strand_edges", "lab"),
        "select node, rep, s from lab",
    ),
    "column_error_test_exact": _sql(EXACT_TEST, "select col, base, n, sum_q, is_error from exact_test"),
    "fingerprint_clusters": _sql(
        PRINT_CLUSTERS,
        """select p.kmer, p.ord, p.read_id, cast(coalesce(c.cluster, 0) as integer) as cluster
       from prints p left join print_clusters c on c.kmer = p.kmer and c.print = p.print""",
    ),
    "paired_cliques": _sql(
        PAIRED_CLIQUES,
        """select kmer, cast(aln as integer) as aln, e as "end", cast(col as integer) as col, ord, file_id, pair + i as pos,
       substr(bases, i + 1, 1) as base from pmembers where size > 1""",
    ),
    "paired_best_match": _sql(PAIRED, "select * from placed_best"),
    "component_members": _sql(MEMBERS, "select rep, s, cast(address // (select fb from orders_n) as integer) as file_id, address % (select fb from orders_n) as pos, gap, base, qual from members"),
    "call_corrections": _sql(CORRECTIONS, "select cast(address // (select fb from orders_n) as integer) as file_id, address % (select fb from orders_n) as pos, gap, base, qual from corrections"),
    "apply_corrections": _sql(FIXED, "select read_id, seq, qual from fixed"),
    "lifted_addresses": _sql(
        FIXED
        + """,
named as (
  select r.file_id, f.read_id, r.name || '/' || (r.file_id + 1) as name, f.seq from fixed f join reads r using (read_id)),
sized as (select *, strlen(name) + 1 + 2 * (len(seq) + 1) + 2 as bytes from named),
laid as (
  select *, cast(sum(bytes) over (order by file_id, read_id) as bigint) - bytes + strlen(name) + 1 as address from sized)""",
        "select name, seq, address, address as lifted from laid",
    ),
    "read_fastq": _sql(
        READS_SQL
        + """,
records as (
  select *, strlen(name) + 1 + strlen(seq) + 1 + 2 + strlen(qual) + 1 as bytes from reads),
laid as (
  select *, cast(sum(bytes) over (order by file_id, read_id) as bigint) - bytes as record_at from records)""",
        "select name, seq, qual, record_at + strlen(name) + 1 as address, record_at from laid",
    ),
    "repeat_groups": _sql(
        PEAK,
        """select count_if(n <= 1) as unique_keys, count_if(n >= 20 * kmer_cov) as repeat_keys,
       cast(coalesce(sum(n) filter (n >= 20 * kmer_cov), 0) as bigint) as repeat_rows from counts, marks""",
    ),
}
