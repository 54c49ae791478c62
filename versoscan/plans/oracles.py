"""SQL that gives the registered queries' rows on DuckDB: named steps, of which each query takes those it needs."""

from __future__ import annotations

import re

from versoscan.operators import choices, rules
from versoscan.plans import inputs as I

SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0]"


def text(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'"


def texts(values: list[str] | None) -> str:
    return "null::varchar[]" if values is None else "[" + ", ".join(map(text, values)) + "]::varchar[]"


def h(*key: str) -> str:
    """The hash judge: a number of [0, 1) from the key's parts."""
    joined = " || '|' || ".join(f"cast({k} as varchar)" for k in key)
    return f"(cast(('0x' || substr(md5({joined}), 1, 8)) as ubigint) / 4294967296.0::double)"


def chars(s: str) -> str:
    """Length of a JSON string with non-ASCII characters kept."""
    return f"(length({s}) + 2 + length(regexp_replace({s}, '[^\"\\\\\\n\\r\\t\\x08\\x0c]', '', 'g')) + 5 * length(regexp_replace({s}, '[^\\x00-\\x07\\x0b\\x0e-\\x1f]', '', 'g')))"


# The presets as the SQL knows them, apart from the library's own: name, scope, threshold and place of each category.
BASE = ["structure", "clarity", "concision", "voice", "naturalness", "anglicism", "substance", "consistency"]
ADDED = {"base": [], "tech-doc": ["rigor", "reader_load", "restraint"], "blog": ["restraint", "honesty"]}
SCOPES = {"concision": "both", "consistency": "document"}


def preset_rows() -> str:
    """(ruleset, pos, name, scope, severity, threshold, locate_threshold, n_levels) of every preset."""
    rows = [f"('{r}', {pos}, '{n}', '{SCOPES.get(n, 'block')}', {1.0 if (r, n) == ('blog', 'voice') else 1.5}::double)" for r, added in ADDED.items() for pos, n in enumerate(BASE + added)]
    return "select ruleset, pos, name, scope, 'warning' as severity, threshold, 0.6::double as locate_threshold, 3 as n_levels from (values " + ", ".join(rows) + ") t(ruleset, pos, name, scope, threshold)"


def active() -> list[dict]:
    """The categories of the queries' ruleset: tech-doc with the queries' own patches; texts are the library's."""
    texts_of = {c["name"]: c for p in rules.PRESETS.values() for c in p["categories"] if "levels" in c}
    own = {c["name"]: c for c in I.OWN_RULES["categories"]}
    out = []
    for name in BASE + ADDED["tech-doc"] + ["length"]:
        given = texts_of.get(name) or own[name]
        fields = {"name": name, "enabled": name != "substance", "scope": SCOPES.get(name, "block"), "severity": "warning", "threshold": 1.0 if name == "voice" else 1.5, "locate_threshold": 0.6}
        if name == "length":
            fields |= {"scope": "both", "severity": "error"}
        out.append(fields | {k: given.get(k) for k in ("description", "levels", "levels_document", "locate")})
    return out


def category_values() -> str:
    rows = []
    for c in active():
        rows.append(f"({text(c['name'])}, {c['enabled']}, {text(c['scope'])}, {text(c['severity'])}, {float(c['threshold'])}::double, {text(c['description'])}, {texts(c['levels'])}, {texts(c['levels_document'])}, {text(c['locate'])}, {float(c['locate_threshold'])}::double)")
    return "select * from (values " + ", ".join(rows) + ") t(name, enabled, scope, severity, threshold, description, levels, levels_document, locate, locate_threshold)"


def last_below(lists: str, bound: str) -> str:
    """The highest 1-based place of a list whose value is at most ``bound``, 0 if there is none."""
    return f"coalesce(list_max(list_filter(range(1, len({lists}) + 1), lambda x: {lists}[x] <= {bound})), 0)"


def steps(window: int, document: int, score: int, locate: int, context: int) -> dict[str, str]:
    s: dict[str, str] = {}
    s["docs"] = """select doc_id, string_agg(b, chr(10) order by p) as text from (
        select doc_id, p, case when doc_id % 6 = 0 and p < 3 then case p when 1 then 'title: x' else '---' end
          when h = 0 then '# ' || s when h in (1, 2) then '- ' || s when h = 3 then '- ' || s || chr(10) || '  ```' || chr(10) || '  code' || chr(10) || '  ```' || chr(10) || '  ' || s when h = 4 then '  - ' || s when h = 5 then '  ' || s
          when h in (6, 7) then '| ' || s || ' |' when h in (8, 9) then '```' when h = 10 then '~~~' when h in (11, 12, 13) then ''
          when h in (14, 15) then '1. ' || s when h = 16 then '* ' || s when h = 17 then '---' when h = 18 then '  ```' else s end as b
        from (select doc_id, p, replace(ln, '. ', '。') as s, (doc_id * 7 + p * 13 + (p * p) % 5) % 29 as h
              from (select doc_id, unnest(string_split(text, chr(10))) as ln, generate_subscripts(string_split(text, chr(10)), 1) - 1 as p from documents)))
        group by doc_id"""
    s["arrays"] = "select doc_id, case when len(a) > 1 and a[len(a)] = '' then a[1:len(a) - 1] else a end as a from (select doc_id, string_split(text, chr(10)) as a from docs)"
    s["lines"] = f"""select doc_id, idx, line, trim(line, ' ') = '' as blank, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})', 1) as mark,
        regexp_replace(line, '^ {{0,3}}(`{{3,}}|~{{3,}})', '') as rest, regexp_matches(line, '^{SPACE}*[|]') as in_table
        from (select doc_id, cast(generate_subscripts(a, 1) - 1 as int) as idx, unnest(a) as line from arrays)"""
    s["front"] = "select l.doc_id, min(l.idx) as last from lines l join lines f on f.doc_id = l.doc_id and f.idx = 0 and trim(f.line) = '---' where l.idx > 0 and trim(l.line) = '---' group by l.doc_id"
    s["marked"] = """select l.*, coalesce(f.last, -1) as front_end, mark <> '' and not (mark[1] = '`' and contains(rest, '`')) as opens from lines l left join front f using (doc_id)"""
    one = """case when {l}.idx <= {l}.front_end then 'フロントマター' when {f} <> '' or {l}.opens then 'コードブロック' when {l}.in_table then '表' end"""
    nxt = """case when {l}.idx <= {l}.front_end then '' when {f} <> '' then case when {l}.mark <> '' and starts_with({l}.mark, {f}) and trim({l}.rest) = '' then '' else {f} end when {l}.opens then {l}.mark else '' end"""
    s["scan"] = f"""select m.doc_id, m.idx, {one.format(l='m', f="''")} as kind, {nxt.format(l='m', f="''")} as fence from marked m where idx = 0
        union all select m.doc_id, m.idx, {one.format(l='m', f='s.fence')}, {nxt.format(l='m', f='s.fence')} from scan s join marked m on m.doc_id = s.doc_id and m.idx = s.idx + 1"""
    s["kinds"] = "select l.doc_id, l.idx, l.line, l.blank, s.kind from lines l join scan s using (doc_id, idx)"
    s["prose"] = "select doc_id, idx, line from kinds where kind is null and not blank"
    rule = r"^ *(-( *-){2,}|\*( *\*){2,}|_( *_){2,}) *$"
    bullet, number = "^ *([-+*])( |$)", "^ *[0-9]{1,9}([.)])( |$)"
    s["items"] = rf"""select doc_id, idx, kind, blank, length(line) - length(ltrim(line, ' ')) as indent,
        case when regexp_matches(line, '{rule}') then null when regexp_matches(line, '{bullet}') then regexp_extract(line, '{bullet}', 1)
          when regexp_matches(line, '{number}') then 'ordered' || regexp_extract(line, '{number}', 1) end as marker,
        case when regexp_matches(line, '{rule}') then 0 when regexp_matches(line, '{bullet}') then length(regexp_extract(line, '^ *[-+*]')) + 1
          when regexp_matches(line, '{number}') then length(regexp_extract(line, '^ *[0-9]{{1,9}}[.)]')) + 1 else 0 end as content,
        lag(kind) over (partition by doc_id order by idx) as kind_before from kinds"""
    keep_content = last_below("t.cs", "t.indent")
    keep_indent = f"case when len(t.cs) > 0 and t.indent >= t.cs[len(t.cs)] then len(t.cs) else {last_below('t.ms', 't.indent')} end"

    def step(prior: str, join: str) -> str:
        return f"""select doc_id, idx,
          case when masked then case when not blank and kind_before is null then ks[1:kc] else ks end when blank then ks when marker is null then ks[1:kc]
            when inside or n = 0 then list_append(ks[1:n], marker) else list_append(ks[1:n - 1], marker) end as ks,
          case when masked then case when not blank and kind_before is null then ms[1:kc] else ms end when blank then ms when marker is null then ms[1:kc]
            when inside or n = 0 then list_append(ms[1:n], indent) else list_append(ms[1:n - 1], least(ms[n], indent)) end as ms,
          case when masked then case when not blank and kind_before is null then cs[1:kc] else cs end when blank then cs when marker is null then cs[1:kc]
            when inside or n = 0 then list_append(cs[1:n], content) else list_append(cs[1:n - 1], content) end as cs,
          case when masked or blank then prev else idx end as prev,
          case when masked then was_blank when blank then true else false end as was_blank,
          case when masked then true when blank then gap else false end as gap,
          case when masked or blank then null else prev end as i,
          case when masked or blank then false when marker is null then kc > 0 else not was_blank and (inside or (n > 0 and ks[n] = marker)) end as together,
          case when masked or blank then false else gap end as across
        from (select *, n > 0 and indent >= cs[n] as inside from (select t.*, {keep_content} as kc, {keep_indent} as n from ({prior} {join}) t))"""

    own = "x.doc_id, x.idx, x.kind is not null as masked, x.kind_before, x.blank, cast(x.indent as int) as indent, x.marker, cast(x.content as int) as content"
    s["lists"] = step(f"select {own}, []::varchar[] as ks, []::int[] as ms, []::int[] as cs, null::int as prev, false as was_blank, false as gap from items x", "where x.idx = 0") + " union all " + step(f"select {own}, s.ks, s.ms, s.cs, s.prev, s.was_blank, s.gap from lists s join items x", "on x.doc_id = s.doc_id and x.idx = s.idx + 1")
    s["pairs"] = "select doc_id, i, idx as j from lists where i is not null and not together and not across"
    s["kept"] = "select doc_id, i, idx as j from lists where i is not null and together and across"
    s["upto"] = "select doc_id, idx, cast(sum(length(line) + 1) over (partition by doc_id order by idx) as bigint) as upto, length(line) + 1 as own from lines"
    s["spans"] = "select p.*, b.upto - a.upto + a.own as size, a.upto - a.own as before, b.upto as after from pairs p join upto a on a.doc_id = p.doc_id and a.idx = p.i join upto b on b.doc_id = p.doc_id and b.idx = p.j"
    s["fitting"] = f"select *, row_number() over (partition by doc_id order by i) as k from spans where size <= {window}"
    fits = f"g.n < 30 and f.after - g.first <= {window}"
    s["packed"] = f"""select doc_id, k, i, j, 0 as win, 1 as n, before as first from fitting where k = 1 union all
        select f.doc_id, f.k, f.i, f.j, case when {fits} then g.win else g.win + 1 end, case when {fits} then g.n + 1 else 1 end, case when {fits} then g.first else f.before end
        from packed g join fitting f on f.doc_id = g.doc_id and f.k = g.k + 1"""
    s["cores"] = "select doc_id, win, min(i) as lo, max(j) as hi, count(*) as n_pairs from packed group by all"
    s["wide"] = f"""select c.doc_id, c.win, c.lo, c.hi, c.n_pairs, min(u.idx) as start from cores c join upto h on h.doc_id = c.doc_id and h.idx = c.hi
        join upto u on u.doc_id = c.doc_id and u.idx between c.lo - 20 and c.lo and (h.upto - u.upto + u.own <= {window} or u.idx = c.lo) group by all"""
    s["windows"] = f"""select c.doc_id, c.win, c.start, c.n_pairs, max(u.idx) as "end" from wide c join upto b on b.doc_id = c.doc_id and b.idx = c.start
        join upto u on u.doc_id = c.doc_id and u.idx between c.hi and c.hi + 20 and (u.upto - b.upto + b.own <= {window} or u.idx = c.hi) group by all"""
    s["asked"] = "select doc_id, win, i, j from packed"
    s["cuts"] = f"select doc_id, j from asked where {h(chr(39) + 'b' + chr(39), 'doc_id', 'i')} >= 0.5"
    s["gaps"] = """select doc_id, i, j, blank_between, masked_between from (select doc_id, lag(idx) over w as i, idx as j, b > lag(b) over w as blank_between, m > lag(m) over w as masked_between from
        (select *, sum(cast(kind is not null as int)) over (partition by doc_id order by idx) as m, sum(cast(kind is null and blank as int)) over (partition by doc_id order by idx) as b from kinds)
        where kind is null and not blank window w as (partition by doc_id order by idx)) where i is not null"""
    s["forced"] = "select doc_id, j from gaps where masked_between and not exists (select 1 from kept k where k.doc_id = gaps.doc_id and k.i = gaps.i and k.j = gaps.j)"
    s["ids"] = "select p.doc_id, p.idx, cast(sum(cast(c.j is not null as int)) over (partition by p.doc_id order by p.idx) as int) as block from prose p left join (select distinct * from (select * from cuts union all select * from forced)) c on c.doc_id = p.doc_id and c.j = p.idx"
    s["blocks"] = """select b.doc_id, b.block, b.start, b."end", array_to_string(a.a[b.start:b."end"], chr(10)) as text from (select doc_id, block, min(idx) + 1 as start, max(idx) + 1 as "end" from ids group by all) b join arrays a using (doc_id)"""
    s["heading"] = f"""select b.doc_id, b.block, coalesce(arg_max(regexp_replace(regexp_replace(trim(k.line), '^#+', ''), '^{SPACE}+|{SPACE}+$', '', 'g'), k.idx), '') as heading
        from blocks b left join kinds k on k.doc_id = b.doc_id and k.idx < b.start - 1 and k.kind is null and regexp_matches(k.line, '^{SPACE}*#') group by all"""
    for name, limit in (("context", 2000), ("short_context", context)):
        s[name] = f"""select doc_id, block, case when length(c) > {limit} then right(c, {limit}) else c end as context from (
            select b.doc_id, b.block, coalesce(string_agg(p.line, chr(10) order by p.idx) filter (b.before - p.before <= {limit} or p.idx = b.near), '') as c
            from (select b.doc_id, b.block, b.start, coalesce(max(q.upto), 0) as before, max(q.idx) as near from blocks b left join proseup q on q.doc_id = b.doc_id and q.idx < b.start - 1 group by all) b
            left join proseup p on p.doc_id = b.doc_id and p.idx < b.start - 1 group by all)"""
    s["proseup"] = "select *, upto - length(line) - 1 as before from (select *, sum(length(line) + 1) over (partition by doc_id order by idx) as upto from prose)"
    s["shown"] = "select doc_id, idx, case when kind is null then line else '[除外: ' || kind || ']' end as line, kind is null or kind is distinct from lag(kind) over (partition by doc_id order by idx) as is_shown, kind from kinds"
    s["masked"] = "select doc_id, string_agg(line, chr(10) order by idx) filter (is_shown) as masked from shown group by doc_id"
    s["bodies"] = """select b.doc_id, b.block, b.start, b."end", string_agg(s.line, chr(10) order by s.idx) filter (s.is_shown or s.idx = b.start - 1) as body from blocks b join shown s on s.doc_id = b.doc_id and s.idx between b.start - 1 and b."end" - 1 group by all"""
    s["cats"] = category_values()
    for scope, levels in (("block", "levels"), ("document", "case when len(levels_document) > 0 then levels_document else levels end")):
        s[f"{scope}_cats"] = f"select name as category, description || {text(rules.AUTHOR_CLAUSE)} as instruction, {levels} as levels from cats where enabled and scope in ('{scope}', 'both')"
    s["qchars"] = f"select sum({chars('category')} + 2 + 2 + 2 + {chars('instruction')} + (select 2 * len(levels) + sum({chars('x')}) from (select unnest(levels) as x))) + 2 + 2 * (count(*) - 1) as question_chars from block_cats"
    s["states"] = "select b.doc_id, b.block, b.start, b.\"end\", h.heading, c.context, b.body from bodies b join heading h using (doc_id, block) join context c using (doc_id, block)"
    s["payloads"] = f"select *, cast(8 + 4 * 3 + 4 * 2 - 4 + 0 + {chars('heading')} + {chars('context')} + {chars('body')} + 5 + question_chars as bigint) as payload from states, qchars"
    # {"heading": h, "context": c, "body": b} has 2 + 2 * 2 separators and 7 + 7 + 4 letters, and 4 characters a name
    s["payloads"] = f"select *, cast(2 + 4 + 18 + 12 + {chars('heading')} + {chars('context')} + {chars('body')} + question_chars as bigint) as payload from states, qchars"
    s["block_requests"] = f"select p.doc_id, p.block, c.category, p.heading, p.context, p.body, c.instruction, c.levels from payloads p, block_cats c where p.payload <= {score}"
    s["with_prose"] = "select distinct doc_id from prose"
    s["doc_requests"] = f"select m.doc_id, c.category, m.masked as state, c.instruction, c.levels from masked m semi join with_prose using (doc_id), document_cats c where length(m.masked) <= {document}"
    block = "coalesce(block, -1)"
    answers = f"{h(chr(39) + 's' + chr(39), 'scope', 'doc_id', block, 'category')} * (len(levels) - 1) as score, {h(chr(39) + 'c' + chr(39), 'scope', 'doc_id', block, 'category')} as confidence"
    s["scores"] = f"select doc_id, scope, block, category, {answers} from (select doc_id, 'block' as scope, block, category, levels from block_requests union all select doc_id, 'document', null, category, levels from doc_requests)"
    s["flagged"] = "select s.*, c.severity, c.locate, c.locate_threshold from scores s join cats c on c.name = s.category and c.enabled where s.score < c.threshold"
    s["sentences"] = rf"""select doc_id, idx, cast(n as int) as n, cast(col as int) as col, text from (
        select doc_id, idx, row_number() over (partition by doc_id, idx order by k) - 1 as n, col, regexp_replace(piece, '{SPACE}+$', '') as text from (
          select doc_id, idx, k, piece, lead + coalesce(sum(length(piece)) over (partition by doc_id, idx order by k rows between unbounded preceding and 1 preceding), 0) as col from (
            select doc_id, idx, length(line) - length(ltrim(line)) as lead, unnest(pieces) as piece, generate_subscripts(pieces, 1) as k from (
              select doc_id, idx, line, case when regexp_matches(ltrim(line), '^[-*+] ') then [trim(line)] else regexp_extract_all(trim(line), '([^。]*。{SPACE}*|[^。]+)') end as pieces from prose)))
        where regexp_replace(piece, '{SPACE}+$', '') <> '')"""
    s["cands"] = """select s.doc_id, b.block, row_number() over (partition by s.doc_id, b.block order by s.idx, s.n) - 1 as cand, s.idx + 1 as line, s.col, s.text from sentences s join blocks b on b.doc_id = s.doc_id and s.idx + 1 between b.start and b."end"
        union all select doc_id, null, row_number() over (partition by doc_id order by idx, n) - 1, idx + 1, col, text from sentences"""
    s["unit_chars"] = f"""select doc_id, block, 2 + 4 + 19 + 12 + {chars('heading')} + {chars('context')} + {chars('body')} as state_chars from states union all select doc_id, null, 2 + 8 + 4 + {chars('masked')} from masked"""
    s["unit_cands"] = f"select doc_id, block, count(*) as n, sum({chars('text')}) as text_chars, sum(length(cast(cand as varchar))) as digits from cands group by all"
    s["sized"] = f"""select f.doc_id, f.scope, f.block, f.category, f.locate, u.state_chars + 16 + c.text_chars + 2 * c.n + c.n * (6 + {chars('f.locate')} + 25) + 2 * c.digits + 2 * c.n as payload
        from flagged f join unit_cands c on c.doc_id = f.doc_id and c.block is not distinct from f.block join unit_chars u on u.doc_id = f.doc_id and u.block is not distinct from f.block where f.locate is not null"""
    s["questions"] = f"select s.doc_id, s.scope, s.block, s.category, c.cand, c.line, c.col, c.text, s.locate || ' Candidate: `candidates[' || c.cand || ']`' as question from sized s join cands c on c.doc_id = s.doc_id and c.block is not distinct from s.block where s.payload <= {locate}"
    for name, salt in (("located", "l"), ("located2", "l2")):
        s[name] = f"select *, {h(text(salt), 'scope', 'doc_id', block, 'category', 'cand')} as prob from questions"
    s["found"] = """select l.doc_id, l.line as start, l.line as "end", l.col, l.scope, l.category, c.severity, l.prob as probability, null::double as score, null::double as confidence, l.text from located l join cats c on c.name = l.category where l.prob >= c.locate_threshold
        union all select f.doc_id, b.start, b."end", 0, f.scope, f.category, f.severity, null, f.score, f.confidence, b.text from flagged f join blocks b on b.doc_id = f.doc_id and b.block = f.block where f.locate is null and f.scope = 'block'
        union all select f.doc_id, 1, len(a.a), 0, f.scope, f.category, f.severity, null, f.score, f.confidence, '' from flagged f join arrays a using (doc_id) where f.locate is null and f.scope = 'document'"""
    s["merged"] = """select doc_id, start, "end", col, case when count(distinct scope) > 1 then 'both' else min(scope) end as scope, category, arg_min(severity, scope) as severity, max(probability) as probability,
        arg_min(score, scope) filter (score is not null) as score, arg_min(confidence, scope) filter (confidence is not null) as confidence, text from found group by doc_id, start, "end", col, category, text"""
    s["skipped"] = f"""select doc_id, null as stage, category, 'no_evaluable_prose' as reason, null::int as start, null::int as "end" from arrays anti join with_prose using (doc_id), document_cats
        union all select doc_id, 'segment', null, 'window_state_too_large', i + 1, j + 1 from spans where size > {window}
        union all select doc_id, null, category, 'state_too_large', null, null from masked, document_cats where length(masked) > {document}
        union all select doc_id, null, category, 'score_state_too_large', start, "end" from payloads, block_cats where payload > {score}
        union all select doc_id, null, category, 'locate_state_too_large', null, null from sized where payload > {locate}"""
    s["summary"] = """select a.doc_id, coalesce(b.n, 0) as blocks, coalesce(v.n, 0) as violations, coalesce(v.e, 0) as errors from arrays a left join (select doc_id, count(*) as n from blocks group by 1) b using (doc_id)
        left join (select doc_id, count(*) as n, count(*) filter (severity = 'error') as e from merged group by 1) v using (doc_id)"""
    s["calls"] = """select doc_id, 'judge-a' as model, n_pairs as size from windows union all select doc_id, 'judge-b', count(*) from scores group by doc_id, scope, block
        union all select doc_id, 'judge-a', count(*) from questions group by doc_id, scope, block, category, cand // 50"""
    s["usage"] = """select a.doc_id, coalesce(u.calls, 0) as calls, coalesce(u.i, 0) as input_tokens, coalesce(u.o, 0) as output_tokens, coalesce(u.m, '') as models from arrays a left join
        (select doc_id, count(*) as calls, cast(sum(size * 7) as bigint) as i, cast(sum(size) as bigint) as o, string_agg(distinct model, ',' order by model) as m from calls group by 1) u using (doc_id)"""
    # evaluation
    s["epairs"] = "select doc_id, cast(doc_id as varchar) as doc, cast(unnest(range(0, len(string_split(text, chr(10))) - 1)) as int) as i from documents"
    s["answers"] = f"""select *, doc_id || '#' || rep as run_id, ['E-E', 'E-C', 'E-A'][doc_id % 3 + 1] as experiment, ['current', 'confidence', 'junction', 'negative', 'role'][doc_id % 5 + 1] as variant, [1, 5, 20][doc_id // 3 % 3 + 1] as q,
        {h("'r'", 'doc_id', 'i', 'rep')} as prob, case when {h("'m'", 'doc_id', 'rep', 'chunk')} < 0.02 then 'm2' else 'm1' end as model
        from (select doc_id, doc, i, i + 1 as j, i // 10 as chunk, cast(unnest(range(0, 5)) as int) as rep from epairs)"""
    s["turned"] = "select *, case when variant = 'negative' then 1 - prob else prob end as p, case experiment when 'E-C' then variant when 'E-A' then cast(q as varchar) else 'current' end as grp from answers"
    s["mixed"] = "select run_id, string_agg(distinct model, ',' order by model) as models from answers group by 1 having count(distinct model) <> 1"
    s["obs"] = "select experiment, grp, doc, i, j, rep, p from turned anti join mixed using (run_id)"
    s["labels_"] = f"""select doc_id, doc, i, i + 1 as j, case when {h("'t'", 'doc_id', 'i')} < 0.45 then 'boundary' when {h("'t'", 'doc_id', 'i')} < 0.9 then 'continue' else 'either' end as label,
        case when {h("'n'", 'doc_id', 'i')} < 0.3 then '見出し' else '' end as note from epairs where {h("'k'", 'doc_id', 'i')} < 0.6"""
    inside = "abs({p} - 0.5) < 0.1 and not abs(abs({p} - 0.5) - 0.1) <= 1e-9 * greatest(abs({p} - 0.5), 0.1)"
    s["stats"] = f"""select experiment, grp, doc, i, j, avg(p) as mean, count(*) as n, coalesce(stddev_samp(p), 0) as sd, count(*) filter ({inside.format(p='p')}) as in_band, count(*) filter (p >= 0.4 and p < 0.6) as in_legacy from obs group by all"""
    s["labelled"] = "select s.*, l.label, case l.label when 'boundary' then 1 when 'continue' then 0 end as truth, l.label = 'continue' and contains(l.note, '見出し') as contested from stats s join labels_ l using (doc, i, j)"
    s["parts"] = "select *, unnest(case when experiment = 'E-E' then ['all', case when cast(doc as bigint) % 2 = 0 then 'even' else 'odd' end] else ['all'] end) as part from labelled"
    s["everything"] = "select *, 'measured' as part from stats where experiment = 'E-E'"
    s["pools"] = "select distinct doc, label, i, j from labels_ where label <> 'either'"
    s["ranked"] = "select *, row_number() over (partition by doc, label order by i, j) - 1 as r, count(*) over (partition by doc, label) as n from pools"
    for name, count in (("specs", 3), ("specs9", 9)):
        s[name] = f"""select doc, question, cast(row_number() over (partition by doc, question order by md5('0|' || question || '|' || i || '|' || j), i, j) - 1 as int) as slot, i, j, label, reused, count(*) over (partition by doc, question) < {choices.OPTIONS} as truncated from (
            select doc, question, i, j, label, false as reused from ranked, (select cast(unnest(range(0, {count})) as int) as question) where label = 'boundary' and r = question * n // {count}
            union all select c.doc, question, c.i, c.j, c.label, c.r < least(question * 5, c.n) from ranked c semi join (select doc from ranked where label = 'boundary') b using (doc), (select cast(unnest(range(0, {count})) as int) as question)
              where c.label = 'continue' and ((c.r >= least(question * 5, c.n) and c.r < least(question * 5, c.n) + 5) or (c.r < least(question * 5, c.n) and c.r < greatest(5 - (c.n - least(question * 5, c.n)), 0))))"""
        s[f"{name}_answers"] = f"select doc, question, cast(floor({h(text('a'), 'doc', 'question')} * count(*)) as int) as slot, round({h(text('f'), 'doc', 'question')}, 1) as confidence from {name} group by doc, question"
    return s


def auc(extra: str, key: str, source: str) -> str:
    return f"""select {key}, case when n_pos > 0 and n_neg > 0 then w / (n_pos * n_neg) end as auc, n_pos, n_neg from (
        select {key}, sum(case when truth = 1 then rank_ end) - count(*) filter (truth = 1) * (count(*) filter (truth = 1) + 1) / 2 as w, count(*) filter (truth = 1) as n_pos, count(*) filter (truth = 0) as n_neg
        from (select *, rank() over (partition by {key} order by mean) + (count(*) over (partition by {key}, mean) - 1) / 2 as rank_ from {source} where truth is not null {extra}) group by all)"""


def measures(key: str, source: str) -> dict[str, str]:
    inside = "abs(mean - 0.5) < 0.1 and not abs(abs(mean - 0.5) - 0.1) <= 1e-9 * greatest(abs(mean - 0.5), 0.1)"
    return {
        "counts": f"select {key}, count(*) as n_pairs, cast(sum(n) as bigint) as n_obs, count(*) filter (label = 'either') as n_either, count(truth) as n_confirmed, count(*) filter (contested) as n_contested from {source} group by all",
        "mass": f"select {key}, sum(in_band) / sum(n) as band_mass, sum(in_legacy) / sum(n) as band_mass_legacy, avg(cast({inside} as int)) as band_mass_pair_mean from {source} group by all",
        "sd": f"select {key}, count(*) as n, avg(sd) as mean, max(case when k = n_ // 2 then sd end) as median, max(sd) as max from (select *, row_number() over (partition by {key} order by sd) - 1 as k, count(*) over (partition by {key}) as n_ from {source}) group by all",
        "auc": auc("", key, source),
        "auc2": auc("and not contested", key, source),
        "brier": f"select {key}, avg((mean - truth) ** 2) as brier from {source} where truth is not null group by all",
        "ece": f"select {key}, sum(abs(c - a)) / sum(n) as ece from (select {key}, len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::double[], lambda b: b <= mean)) as bin, sum(mean) as c, sum(truth) as a, count(*) as n from {source} where truth is not null group by all) group by all",
    }


def questions_text(i: str, j: str) -> str:
    return f"'The document is given as numbered lines in state.lines. Does a new block — a change of topic, role, or structure such as a new section, list, or paragraph — begin between `lines[' || ({i}) || ']` and `lines[' || ({j}) || ']`?'"


def selects() -> dict[str, tuple[str, str]]:
    """Of each query the steps' limits it runs with (large, small) and its last select."""
    q: dict[str, tuple[str, str]] = {}

    def add(name: str, sql: str, limits: str = "large") -> None:
        q[name] = (limits, sql)

    ex = "experiment, grp"
    m = measures(ex, "stats")
    ml = measures(ex, "labelled")
    add("read_documents", "select doc_id, text from docs")
    path = r"regexp_replace(url, '^https?://|[?].*$', '', 'g')"
    excluded = "^([.]git|[.]hg|[.]svn|_build|build|dist|node_modules|[.]venv|venv|[.]tox|[.]nox|[.]mypy_cache|[.]pytest_cache|[.]ruff_cache|__pycache__|.*[.]egg-info|[.]worktrees|[.]claude|[.]devin|[.]agents|[.]cursor)$"
    parts = "list_filter(string_split(path, '/'), lambda x: x <> '')"
    above = f"list_transform(range(1, len({parts}) + 1), lambda k: array_to_string(({parts})[1:k], '/'))"
    some = lambda lists, pattern: f"len(list_filter({lists}, lambda x: regexp_matches(x, '{pattern}'))) > 0"
    add("path_excludes", f"select page_id, path, {some(parts, excluded)} as by_default, {some(f'list_concat({parts}, {above})', '^(.*/fr/.*|th.*|1.)$')} as by_pattern from (select page_id, {path} as path from pages)")
    add("excluded_counts", f"select root, count(*) as files, count(*) filter ({some(parts_of := 'list_filter(string_split(rel, chr(47)), lambda x: x <> chr(0) and x <> ' + chr(39) * 2 + ')', excluded)} or {some(f'list_concat({parts_of}, list_transform(range(1, len({parts_of}) + 1), lambda k: array_to_string(({parts_of})[1:k], chr(47))))', '^(.*2.*|de)$')}) as excluded from (select string_split(path, '/')[1] as root, substr(path, length(string_split(path, '/')[1]) + 2) as rel from (select {path} as path from pages)) group by all")
    add("excluded_files", """select cast(count(*) as bigint) as files, count(*) filter (bad) as excluded, count(*) filter (not bad) as "read" from (
        select doc_id % 6 = 3 or doc_id % 4 = 2 or doc_id % 10 = 7 as bad from docs)""")
    add("split_lines", "select doc_id, idx, line from lines")
    add("mask_syntax", "select doc_id, idx, kind from kinds where kind is not null")
    add("masked_text", "select doc_id, masked from masked")
    add("masked_block_body", "select doc_id, block, body from bodies")
    add("prose_lines", "select doc_id, idx, line from prose")
    add("no_prose_skips", "select a.doc_id, c.category, 'no_evaluable_prose' as reason from (select doc_id from docs anti join with_prose using (doc_id)) a, document_cats c")
    add("list_items", "select doc_id, idx, cast(indent as int) as indent, marker, cast(content as int) as content from items")
    add("boundary_candidates", "select doc_id, i, j from pairs")
    add("list_continuations", "select doc_id, i, j from kept")
    add("line_pairs", "select * from gaps")
    add("pack_windows", 'select doc_id, win, start, "end", n_pairs from windows', "small")
    add("uninspected_pairs", "select doc_id, stage, reason, start, \"end\" from skipped where reason = 'window_state_too_large'", "small")
    add("boundary_requests", f"select a.doc_id, a.win, a.i, a.j, 'b' || a.i as key, {questions_text('a.i - w.start', 'a.j - w.start')} as question, array_to_string(x.a[w.start + 1:w.\"end\" + 1], chr(10)) as state from asked a join windows w using (doc_id, win) join arrays x using (doc_id)")
    add("sentence_candidates", "select doc_id, idx, n, col, text from sentences")
    add("line_prefix_chars", "select doc_id, idx, upto from upto")
    add("payload_chars", "select doc_id, block, payload from payloads")
    add("input_hash", "select doc_id, sha256(text) as sha256 from docs")
    escaped = "replace(replace(x, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')"
    for k in range(1, 32):
        escaped = f"replace({escaped}, chr({k}), chr(92) || '{({8: 'b', 9: 't', 10: 'n', 12: 'f', 13: 'r'}).get(k, f'u{k:04x}')}')"
    add("state_hash", f"""select w.doc_id, w.win, sha256('{{"lines": [' || array_to_string(list_transform(x.a[w.start + 1:w."end" + 1], lambda x: '"' || {escaped} || '"'), ', ') || ']}}') as sha256 from windows w join arrays x using (doc_id)""")
    add("read_ruleset", f"select s.source, p.* from (select distinct source from documents) s, ({preset_rows()}) p")
    add("categories_by_scope", "select (select count(*) from documents) as documents, s.scope, c.name, c.threshold from cats c, (values ('block'), ('document')) s(scope) where c.enabled and c.scope in (s.scope, 'both')")
    s = lambda k: f"list_transform(range(1, cast({k} as bigint) + 1), lambda x: cast(x as varchar))"
    ruled = f"""(select 'c' || doc_id as name, doc_id, case when doc_id % 3 = 0 then 'document' else 'block' end as scope, doc_id % 4 / 2 as threshold, case when doc_id % 5 = 0 then '' else source end as description,
        {s('doc_id % 7')} as levels, case when doc_id % 2 = 0 then {s('doc_id % 6 + 1')} end as levels_document, case when doc_id % 3 > 0 then '引用 ' || lang || case when doc_id % 4 > 0 then ' ルール定義 説明例' else '' end end as locate,
        case when doc_id % 11 = 0 then 'nan'::double else doc_id % 13 / 10 end as locate_threshold from documents)"""
    add("invalid_categories", f"""select name as category, field, message from {ruled}, (values ('levels', 'must have 2 to 5 entries'), ('levels_document', 'must have 2 to 5 entries'), ('locate_threshold', 'must be a finite value in [0, 1]'), ('description', 'is required with levels')) f(field, message)
        where case field when 'levels' then len(levels) not in (0, 2, 3, 4, 5) when 'levels_document' then len(levels_document) not between 2 and 5 when 'locate_threshold' then isnan(locate_threshold) or locate_threshold not between 0 and 1 else len(levels) > 0 and description = '' end""")
    add("merged_categories", f"""select name, scope, threshold, description, n_levels, cast(row_number() over (order by new, name) - 1 as int) as pos from (
        select name, 'both' as scope, 0.25 as threshold, description, len(levels) as n_levels, 0 as new from {ruled}
        union all select name || 'x', scope, threshold, description, len(levels), 1 from {ruled})""")
    add("rule_text_contracts", f"select name as category, word, contains(locate, word) as present from {ruled}, (values {', '.join(f'({text(w)})' for w in rules.CONTRACT_WORDS)}) w(word) where locate is not null")
    add("block_score_requests", "select doc_id, block, category, heading, context, body, instruction, array_to_string(levels, '|') as levels from block_requests")
    add("document_score_requests", "select doc_id, category, state, instruction, array_to_string(levels, '|') as levels from doc_requests")
    add("locate_requests", """select q.doc_id, q.scope, q.block, q.category, cast(q.cand // 50 as int) as chunk, any_value(u.heading) as heading, any_value(u.context) as context, any_value(u.body) as body, any_value(u.document) as document,
        any_value(c.candidates) as candidates, string_agg(q.question, chr(10) order by q.cand) as questions from questions q
        join (select doc_id, block, heading, context, body, null as document from states union all select doc_id, null, null, null, null, masked from masked) u on u.doc_id = q.doc_id and u.block is not distinct from q.block
        join (select doc_id, block, string_agg(text, chr(10) order by cand) as candidates from cands group by all) c on c.doc_id = q.doc_id and c.block is not distinct from q.block group by q.doc_id, q.scope, q.block, q.category, q.cand // 50""")
    add("size_skips", "select * from skipped where reason in ('state_too_large', 'score_state_too_large')", "small")
    add("question_chunks", "select doc_id, scope, block, category, cand, cast(cand // 5 as int) as chunk from questions")
    add("nearest_heading", "select * from heading")
    add("preceding_context", "select * from short_context")
    add("boundary_cuts", "select * from cuts")
    add("forced_cuts", "select * from forced")
    add("block_ids", "select * from ids")
    add("build_blocks", "select * from blocks")
    add("block_lines", 'select b.doc_id, b.block, l.idx, l.line from blocks b join lines l on l.doc_id = b.doc_id and l.idx between b.start - 1 and b."end" - 1')
    noul = f"select a.doc_id, a.win, 'b' || a.i as key, {h(text('b'), 'a.doc_id', 'a.i')} as prob, 'judge-a' as model, length({questions_text('a.i - w.start', 'a.j - w.start')}) as asked from asked a join windows w using (doc_id, win)"
    add("judge_noul", f"select doc_id, win, key, prob, model from ({noul})")
    add("judge_score", "select doc_id, category, score, confidence, 'judge-b' as model from scores where scope = 'document'")
    add("judge_choice", f"select doc, question, cast(cast(floor({h(text('a'), 'doc', 'question')} * count(*)) as int) as varchar) as choice, {h(text('f'), 'doc', 'question')} as confidence, cast(count(*) as int) as n_options, 1.0::double as probability from specs group by doc, question")
    add("record_calls", f"select doc_id, win, min(model) as model, cast(sum(asked) as bigint) as input_tokens, count(*) as output_tokens from ({noul}) group by doc_id, win")
    add("score_gate", "select doc_id, scope, block, category, score, confidence, severity from flagged")
    add("locate_violations", 'select doc_id, start, "end", col, scope, category, severity, probability, text from found where probability is not null')
    add("score_flag_violations", 'select doc_id, start, "end", col, scope, category, severity, score, confidence, text from found where probability is null')
    add("all_violations", 'select doc_id, scope, category, start, "end", col, text from found')
    add("merge_violations", "select * from merged")
    add("lint_corpus", "select * from merged")
    add("all_skipped", "select * from skipped", "small")
    add("file_summary", "select * from summary")
    add("usage_summary", "select * from usage")
    add("exit_codes", "select doc_id, cast(errors > 0 as int) as exit_code from summary")
    add("run_exit_code", "select cast(coalesce(max(cast(errors > 0 as int)), 0) as int) as exit_code, count(*) filter (errors > 0) as failed, count(*) as documents from summary")
    add("fail_under", """select category, case when max(error) = 1 or coalesce(min(score), 3.0) < 0.002 then 1 else 0 end as exit_code, coalesce(min(score), 3.0) as worst from (
        select category, score, 0 as error from scores union all select category, null, cast(severity = 'error' as int) from merged) group by category""")
    place = lambda mark: f"case when start is not null then ' L' || start || '-{mark}' || \"end\" else '' end"
    add("skipped_lines", f"select doc_id, coalesce(category, stage, '?') || {place('L')} || ' skipped (' || reason || ')' as line from skipped", "small")
    add("report_lines", f"""select doc_id, 0 as part, doc_id || ': ' || blocks || ' blocks, ' || violations || ' violations' as line from summary
        union all select doc_id, 1, '  L' || start || '-' || "end" || ' [' || severity || '] ' || category || ' ' || case when probability is not null then printf('P=%.2f', probability) else printf('score=%.1f', score) end || ' ' || substr(text, 1, 70) from merged
        union all select doc_id, 2, '  skipped: ' || coalesce(category, stage, '?') || ' (' || reason || ')' || {place('')} from skipped
        union all select doc_id, 3, '  usage: ' || calls || ' calls, input=' || input_tokens || ', output=' || output_tokens || case when models <> '' then ' [' || replace(models, ',', ', ') || ']' else '' end from usage""")
    add("report_json", """select s.doc_id, s.blocks, (select count(*) from scores x where x.doc_id = s.doc_id and scope = 'document') as doc_scores, s.violations, (select count(*) from skipped x where x.doc_id = s.doc_id) as skipped, s.errors, u.calls from summary s join usage u using (doc_id)""")
    sweep = lambda key: f"""select {key} n, threshold, cast(raw as bigint) as raw, merged from (select {key} threshold, count(*) as n, sum(raw) as raw, count(*) filter (top >= threshold) as merged from (
        select category, threshold, max(prob) as top, count(*) filter (prob >= threshold) as raw from located, (values (0.5::double), (0.6), (0.7), (0.8)) t(threshold) group by doc_id, line, col, text, category, threshold) group by all)"""  # noqa: E731
    add("threshold_sweep", sweep(""))
    add("threshold_sweep_by_category", sweep("category, "))
    swept = sweep("")
    add("eval_dump", f"""select 'candidates' as name, count(*) as n_rows, count(*) filter (prob >= 0.6) as figure from located union all select 'calls', count(*), cast(sum(size * 7) as bigint) from calls
        union all select 'thresholds', count(*), cast(sum(merged) as bigint) from ({swept}) union all select 'inputs', count(*), count(distinct text) from docs""")
    contents = """select w.doc_id, array_to_string(x.a[w.start + 1:w."end" + 1], chr(10)) as state, string_agg(p.i || '-' || p.j, ',' order by p.i) as asked, count(*) as n
        from windows w join arrays x using (doc_id) join asked p using (doc_id, win) group by w.doc_id, w.win, x.a, w.start, w."end\""""
    add("reused_answers", f"""select 'first' as run, count(*) as requests, count(distinct (state, asked)) as asked, cast(sum(n) as bigint) as answers from ({contents}) where doc_id % 2 = 0
        union all select 'second', count(*), count(distinct (state, asked)) - (select count(distinct (state, asked)) from ({contents}) where doc_id % 2 = 0), cast(sum(n) as bigint) from ({contents})""")
    matched = 'select a.doc_id, a.scope, a.line as start, a.line as "end", a.col, a.text, a.category, a.prob as base_prob, b.prob as new_prob from located a join located2 b on a.doc_id = b.doc_id and a.scope = b.scope and a.line = b.line and a.col = b.col and a.text = b.text and a.category = b.category'
    add("matched_candidates", matched)
    add("regression_check", f"""select *, abs(median_shift) > 0.03 or up >= 0.2 or down >= 0.2 as regression from (select category, count(*) as n, quantile_cont(new_prob - base_prob, 0.5) as median_shift, avg(cast(new_prob - base_prob >= 0.05 as int)) as up, avg(cast(new_prob - base_prob <= -0.05 as int)) as down from ({matched}) group by all)""")
    add("polarity", "select run_id, 'b' || i as key, p from turned")
    add("discarded_runs", "select * from mixed")
    add("run_totals", "select count(*) as runs, cast(coalesce(sum(n) filter (m = 1), 0) as bigint) as requests, count(*) filter (m <> 1) as discarded from (select run_id, count(distinct chunk) as n, count(distinct model) as m from answers group by 1)")
    inside = "experiment <> 'E-E' or doc = '0'"
    add("observation_series", f"select experiment, grp, case when {inside} then 'window' else 'design' end as doc, i - case when experiment = 'E-E' and doc = '0' then {I.OFFSET} else 0 end as i, j - case when experiment = 'E-E' and doc = '0' then {I.OFFSET} else 0 end as j, rep, p from obs")
    add("window_offset", """select doc_id, cast(case when len(w) = 0 then null when doc_id % 2 = 0 then 2 else (list_filter(range(0, len(a) - len(w) + 1), lambda k: a[k + 1:k + len(w)] = w))[1] end as int) as at from (select doc_id, a, a[3:5] as w from (select doc_id, string_split(text, chr(10)) as a from documents))""")
    add("labeled_observations", "select o.doc, o.i, o.j, experiment, grp, rep, p, label from obs o join labels_ l using (doc, i, j)")
    add("labels_in_window", "select doc, i, j, label from labels_ semi join (select distinct doc, i, j from obs) o using (doc, i, j)")
    add("pair_stats", "select experiment, grp, doc, i, j, mean, n, sd from stats")
    add("repeat_sd_summary", m["sd"])
    add("band_mass", f"select {ex}, band_mass, band_mass_pair_mean from ({m['mass']})")
    add("band_mass_legacy", f"select {ex}, band_mass_legacy from ({m['mass']})")
    add("boundary_auc", ml["auc"])
    add("boundary_auc_no_contested", ml["auc2"])
    add("brier_score", ml["brier"])
    add("calibration_error", ml["ece"])
    add("flip_curve", f"""select {ex}, t / 100 as threshold, avg(cast(low < t / 100 and high >= t / 100 as int)) as flip from (select {ex}, min(p) as low, max(p) as high from obs o join labels_ l using (doc, i, j) where label <> 'either' group by {ex}, doc, i, j), (select unnest(range(30, 71, 2)) as t) group by all""")
    split = "(select *, case when truth is not null then 'confirmed' else 'either' end as split from labelled)"
    sm = measures(f"{ex}, split", split)
    exact = sm["sd"].replace("avg(sd) as mean", "avg(cast(sd as decimal(30, 15))) as mean")  # the query's rule: the order of adding plays no part
    add("label_split_stats", f"select a.experiment, a.grp, a.split, a.band_mass, b.n as n_pairs, b.mean as sd_mean, b.median as sd_median, b.max as sd_max from ({sm['mass']}) a join ({exact}) b using (experiment, grp, split)")
    add("boundary_group_counts", ml["counts"])
    k3 = f"{ex}, part"
    p, e = measures(k3, "parts"), measures(k3, "everything")
    using = "using (experiment, grp, part)"
    add("boundary_report", f"""select {k3}, n_pairs, n_obs, n_either, n_confirmed, n_contested, band_mass, band_mass_legacy, band_mass_pair_mean, sd.mean as sd_mean, sd.median as sd_median, sd.max as sd_max, a.auc, a.n_pos, a.n_neg, b.auc as auc_no_contested, brier, ece
        from ({p['counts']}) join ({p['mass']}) {using} join ({p['sd']}) sd {using} left join ({p['auc']}) a {using} left join ({p['auc2']}) b {using} left join ({p['brier']}) {using} left join ({p['ece']}) {using}
        union all select {k3}, sd.n, (select cast(sum(n) as bigint) from everything x where x.grp = sd.grp), null, null, null, band_mass, band_mass_legacy, band_mass_pair_mean, sd.mean, sd.median, sd.max, null, null, null, null, null, null from ({e['mass']}) join ({e['sd']}) sd {using}""")
    add("label_counts", "select count(*) as total, count(*) filter (label = 'boundary') as boundary, count(*) filter (label = 'continue') as continue, count(*) filter (label = 'either') as either, count(*) filter (label <> 'either' and doc_id % 4 = 0) as window_confirmed from labels_")
    add("cache_check", "select not bool_or(doc_id % 100 = 7) as identical, count(*) filter (doc_id % 100 = 7) as differing from epairs")
    add("read_runs", "select experiment, doc, rep, variant, case when variant = 'negative' then -1 else 1 end as polarity, q, model, count(*) over (partition by run_id, chunk) as input_tokens, i, j, prob from answers")
    add("read_labels", "select doc, i, j, label, 'plain' as stratum, note from labels_")
    add("heading_rule_baseline", "select count(*) as n, avg(cast(heading = truth as int)) as accuracy, count(*) filter (heading and truth) / nullif(count(*) filter (heading), 0) as precision from (select starts_with(ltrim(n.line, ' '), '#') as heading, l.label = 'boundary' as truth from labels_ l join lines n on n.doc_id = l.doc_id and n.idx = l.j where l.label <> 'either')")
    add("window_dispersion", "select run_id, chunk, count(*) as n, coalesce(stddev_samp(prob), 0) as sd, min(prob) as least, max(prob) as greatest from answers group by all")
    up = lambda n: f"(cast(ceil((select count(*) from labels_) / {n}) as bigint))"
    plan = f"select 'E-E' as stage, (select count(*) from windows) * 5 as requests union all select 'E-C', {up(10)} * 15 union all select 'E-A', ({up(1)} + {up(5)} + {up(20)}) * 3 union all select 'E-CHOICE', cast(ceil((select count(*) from asked) / 10) as bigint) * 3"
    add("request_plan", f"{plan} union all select 'total', cast(sum(requests) as bigint) from ({plan})")
    add("choice_pools", f"select distinct 'plan' as doc, label, case when doc_id % 2 = 0 then i + {I.OFFSET} else i end as i, case when doc_id % 2 = 0 then j + {I.OFFSET} else j end as j from labels_ where label <> 'either'")
    add("choice_questions", "select * from specs")
    right = "(select doc, question, slot as r from specs where label = 'boundary')"
    add("choice_accuracy", f"select count(*) as questions, count(*) filter (r = a.slot) as correct, count(*) filter (r = a.slot) >= 4 as control from {right} left join specs_answers a using (doc, question)")
    top = "select * from (select *, row_number() over (partition by doc order by confidence desc, question) as place from specs9_answers) where place <= 3"
    add("top_confidence", top)
    add("control_unchanged", f"select coalesce(bool_and(question <> 8), true) as unchanged, count(*) as controls from ({top})")
    add("pair_chunks", "select doc, i, i + 1 as j, q, cast(i // q as int) as chunk from epairs, (values (1), (5), (20)) t(q)")
    asked = lambda t: "'" + t.replace("%d", "' || i || '", 1).replace("%d", "' || (i + 1) || '", 1) + "'"
    wordings = [("current", 1, questions_text("i", "i + 1")), ("confidence", 1, questions_text("i", "i + 1") + f" || {text(choices.CONFIDENCE_CLAUSE)}"), ("junction", 1, asked(choices.JUNCTION)), ("role", 1, asked(choices.ROLE)), ("negative", -1, asked(choices.NEGATIVE))]
    add("question_variants", " union all ".join(f"select doc, i, i + 1 as j, '{n}' as variant, {s} as polarity, rep, {t} as question from epairs, (values (0), (1)) r(rep)" for n, s, t in wordings))
    add("shrink_state", f"""select doc_id as doc, idx from (select doc_id, idx, d, (sum({chars('line')} + 2) over (partition by doc_id order by d)) - 2 + 13 as size from (
        select l.doc_id, l.idx, any_value(l.line) as line, min(abs(l.idx - e.idx)) as d from lines l left join lines e on e.doc_id = l.doc_id and e.idx >= 1 and e.idx % 9 in (3, 4) where l.idx >= 1 group by l.doc_id, l.idx)) where d = 0 or size <= 600""")
    return q


def oracle_sql(small) -> dict[str, str]:
    sets = {"large": steps(16000, 32000, 32000, 32000, 400), "small": steps(small.window, small.document, small.score, small.locate, 400)}
    out = {}
    for name, (limits, select) in selects().items():
        known = sets[limits]
        order: list[str] = []

        def need(sql: str, known: dict[str, str] = known, order: list[str] = order, seen: set[str] | None = None) -> None:
            seen = seen if seen is not None else set()
            for step in known:
                if step not in order and step not in seen and re.search(rf"\b{step}\b", sql):
                    seen.add(step)
                    need(known[step], known, order, seen)
                    if step not in order:
                        order.append(step)

        need(select)
        head = "with recursive " + ",\n".join(f"{s} as ({'' if s in ('scan', 'lists', 'packed') else 'materialized '}{known[s]})".replace("as (materialized ", "as materialized (") for s in order) if order else ""
        out[name] = f"{head}\n{select}"
    return out
