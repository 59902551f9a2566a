"""The queries of this package and, where SQL can say the same, their SQL."""

from . import canonical, match, names, pack, scans, split, tokens, toxic

QUERIES = {f.__name__: f for f in (match.p1_found, match.p1_confidence, scans.p2_found, scans.p2_paragraphs, split.p3_found, split.p3_pieces, canonical.p4_found, canonical.p4_misses, names.p5_found, names.p5_entities, tokens.p6_ids, tokens.p6_counts, pack.p7_pack, pack.p7_room, toxic.p8_found, toxic.p8_scores, toxic.p8_rates)}

_SECTIONS = (
    "s as (select * from sections where ord is not null qualify row_number() over (partition by paper_id, ord order by generated_at desc, coalesce(start_offset, -1) desc) = 1), "
    "v as (select *, lead(start_offset) over (partition by paper_id order by ord) as nxt from s where start_offset is not null), m as (select paper_id, arg_max(md, generated_at) as md from paper_md group by paper_id), "
    "t as (select v.paper_id, v.ord, v.title, substring(md, start_offset + 1, coalesce(end_offset, nxt, length(md)) - start_offset) as span from v join m on m.paper_id = v.paper_id)"
)
_LONGEST = lambda array: f"list_max(list_transform({array}, lambda x: length(x)))"
_PARAGRAPHS = r"regexp_split_to_array(span, '(\r\n|\r|\n)[^\S\r\n]*(\r\n|\r|\n)\s*')"
_SENTENCES = r"string_split(regexp_replace(regexp_replace(span, '(\r\n|\r|\n)[^\S\r\n]*(\r\n|\r|\n)\s*', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_RUNS = r"regexp_split_to_array(span, '\s+')"

SQL: dict[str, str] = {
    "p3_found": f"with {_SECTIONS} select paper_id, ord, case when {_LONGEST(_PARAGRAPHS)} <= 3000 then 'paragraph' when {_LONGEST(_SENTENCES)} <= 3000 then 'sentence' when {_LONGEST(_RUNS)} <= 3000 then 'word' else 'none' end as boundary from t where length(span) > 3000",
}
