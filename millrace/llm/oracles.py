"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str, lower: bool) -> str:
    text = f"coalesce({text}, '')"
    text = f"translate({text}, '{UPPER}', '{LOWER}')" if lower else text
    return f"regexp_extract_all({text}, '{pattern}')"


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"

OP1 = f"""
with d as materialized (select doc_id, {_words('text', ALNUM, True)} w from documents),
b as materialized (select cast(item_id as varchar) item, {_words('text', ALNUM, True)} w from benchmark),
bw as materialized (
  select distinct item, least(13, len(w)) k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') win
  from b, range(1, len(w) - least(13, len(w)) + 2) r(i) where len(w) > 0),
ks as (select distinct k from bw),
dw as materialized (
  select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') win from d, ks, range(1, len(w) - k + 2) r(i) where len(w) >= k),
hit as materialized (select doc_id, i, dw.k, item from dw join bw on dw.win = bw.win and dw.k = bw.k),
spot as (select doc_id, count(distinct j) n_hit from hit, range(i, i + k) s(j) group by 1),
items as (
  select doc_id, count(distinct item) n_items, array_to_string(list_sort(list(distinct item)), ',') s from hit group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join spot using (doc_id) left join items using (doc_id)
"""

OP4 = f"""
with recursive d as materialized (select doc_id, {_words('text', NOT_SPACE, True)} w from documents),
s as materialized (
  select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i : i + 3], ' ') end x
  from d, range(1, greatest(len(w) - 2, 2)) r(i) where len(w) > 0),
n as materialized (select doc_id, count(*) n from s group by 1),
link as materialized (
  select a.doc_id a, b.doc_id b from s a join s b on a.x = b.x and a.doc_id < b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by 1, 2, na.n, nb.n having 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
pair as materialized (select a, b from link union all select b, a from link),
reach(a, b) as (select doc_id a, doc_id b from d union select r.a, k.b from reach r join pair k on r.b = k.a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, c.component_id, d.doc_id = c.component_id kept
from d left join n using (doc_id) join (select a doc_id, min(b) component_id from reach group by 1) c using (doc_id)
"""

OP5 = f"""
with d as materialized (select doc_id, {_words('text', NOT_SPACE, False)} w from documents),
win as materialized (select doc_id, i, array_to_string(w[i : i + 12], ' ') x from d, range(1, len(w) - 11) r(i) where len(w) >= 13),
least_doc as materialized (select x, min(doc_id) m from win group by 1),
gone as materialized (
  select distinct doc_id, j from win join least_doc using (x), range(i, i + 13) s(j) where m < doc_id),
word as (select doc_id, i, w[i] x from d, range(1, len(w) + 1) r(i)),
kept as (
  select doc_id, string_agg(x, ' ' order by i) t from word where not exists (
    select 1 from gone g where g.doc_id = word.doc_id and g.j = word.i) group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(g.n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join (select doc_id, count(*) n from gone group by 1) g using (doc_id) left join kept using (doc_id)
"""


OP11 = """
with v as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * cast(x as double))) q
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (
  select a.vec_id a, b.vec_id b, a.l = b.l same, cast(list_dot_product(a.q, b.q) as bigint) s
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as materialized (
  select a, b p, s ps from (select *, row_number() over (partition by a order by s desc, b) n from s where same) where n <= 5),
n as (
  select p.a, p.p, p.ps, s.b, s.s, row_number() over (partition by p.a, p.p order by s.s desc, s.b) r
  from p join s on p.a = s.a and not s.same and 50 * ps <= 100 * s.s and 100 * s.s <= 95 * ps)
select a anchor_id, p positive_id, cast(r as integer) rank, b negative_id, ps positive_score, s negative_score from n where r <= 3
"""


#: Tests that compare what SQL cannot express with brute force, an exact round trip or held-out labels.
CERTIFICATES = {
    "op2_fingerprints": "tests/llm/test_stages.py::test_fingerprints_of_documents",
    "op3_quality": "tests/llm/test_stages.py::test_the_identity_is_the_sum_over_pairs",
    "op6_chat": "tests/llm/test_operators.py::test_chat",
    "op7_warc": "tests/llm/test_operators.py::test_warc",
    "op8_packing": "tests/llm/test_operators.py::test_packing",
    "op9_orc_ids": "tests/llm/test_operators.py::test_orc_ids",
    "op10_main_text": "tests/llm/test_operators.py::test_main_text",
    "op12_licenses": "tests/llm/test_new_operators.py::test_licenses",
    "op13_cross_tokens": "tests/llm/test_new_operators.py::test_cross_tokens_of_documents",
    "pipeline": "tests/llm/test_stages.py::test_substring_stage_takes_repeated_words",
}


def all_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op4_near_duplicates": OP4, "op5_repeated_passages": OP5, "op11_hard_negatives": OP11}
