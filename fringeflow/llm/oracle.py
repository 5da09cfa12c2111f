"""SQL counterparts, for DuckDB, of the queries of this subpackage that SQL can express."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from fringeflow.llm.sharding import Leaf, topology

TAG = r"(?i)<(?:link|meta)\b[^>]*(?:canonical|refresh)[^>]*>"
TARGET = r"""(?i)(?:href|url)\s*=\s*["'']?\s*([^"''>\s]+)"""


def _rest(url: str) -> str:
    return f"(case when contains({url}, '://') then substr({url}, position('://' in {url}) + 3) end)"


def _host(url: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"coalesce(translate(regexp_extract({_rest(url)}, '^[^/?#]*'), '{upper}', '{lower}'), '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({_rest(url)}, '^[^/?#]*([^?#]*)', 1), '')"


def _alias(url: str) -> str:
    host = f"regexp_replace({_host(url)}, '^(www|m)\\.', '')"
    path = f"regexp_replace({_path(url)}, '(/index)?(\\.html)?/?$', '')"
    query = f"regexp_extract({_rest(url)}, '^[^?#]*\\?([^#]*)', 1)"
    query = f"regexp_replace({query}, '(^|&)(utm_[a-z]*|ref)=[^&]*', '', 'g')"
    return f"case when contains({url}, '://') then {host} || {path} || '?' || {query} end"


def _rule(url: str, rules: Mapping[str, str]) -> str:
    cases = []
    for rule in sorted(rules, key=len, reverse=True):
        host, slash, start = rule.partition("/")
        of_host = f"({_host(url)} = '{host}' or ends_with({_host(url)}, '.{host}'))"
        cases.append(f"when {of_host} and starts_with({_path(url)}, '{slash}{start}') then '{rule}'")
    return f"case {' '.join(cases)} end"


def _verdict(rule: str, rules: Mapping[str, str]) -> str:
    return f"case {rule} " + " ".join(f"when '{r}' then '{v}'" for r, v in rules.items()) + " end"


def url_filter(rules: Mapping[str, str]) -> str:
    """Blocks spread along links from every blocked url, by recursion."""
    scheme, root = "regexp_extract(src, '^[^:/?#]*:')", f"regexp_extract({_rest('src')}, '^[^/?#]*')"
    absolute = (
        f"case when starts_with(t, '//') then {scheme} || t when starts_with(t, '/')"
        f" then {scheme} || '//' || {root} || t else t end"
    )
    return f"""with recursive tags as (
            select url as src, unnest(regexp_extract_all(html, '{TAG}')) as tag from pages),
        targets as (select src, regexp_extract(tag, '{TARGET}', 1) as t from tags),
        links as (select src, {absolute} as dst from targets),
        edges as (select distinct {_alias('src')} as a, {_alias('dst')} as b from links
            where contains(src, '://') and contains(dst, '://')),
        judged as (select page_id, {_host('url')} as host, {_path('url')} as path, {_alias('url')} as alias,
            {_rule('url', rules)} as rule from pages),
        seeds as (select alias from judged where {_verdict('rule', rules)} = 'block'
            union select {_alias('dst')} from links where {_verdict(f"({_rule('dst', rules)})", rules)} = 'block'),
        reached as (select alias from seeds where alias is not null
            union select case when e.a = r.alias then e.b else e.a end
            from reached r join edges e on r.alias in (e.a, e.b))
        select page_id, host, path, rule, coalesce({_verdict('rule', rules)},
            case when alias in (select alias from reached) then 'block' else 'allow' end) as verdict,
            rule is null and coalesce(alias in (select alias from reached), false) as propagated from judged"""


def _pick(level: str, weights: Mapping[str, float]) -> str:
    draws = []
    for name, weight in weights.items():
        unit = f"(cast('0x' || substr(md5(key || '/{level}/{name}'), 1, 12) as bigint) + 0.5::double) / 281474976710656"
        draws.append(f"{{'d': -ln({unit}) / {weight}, 'n': '{name}'}}")
    return f"(list_sort([{', '.join(draws)}])[1]).n"


def _shard(leaves: Sequence[Leaf]) -> str:
    """The shard drawn, level by level, as one expression over ``key``."""
    regions = {x.region: sum(y.weight for y in leaves if y.region == x.region) for x in leaves}
    by_region = []
    for region in regions:
        inside = [x for x in leaves if x.region == region]
        racks = {x.rack: sum(y.weight for y in inside if y.rack == x.rack) for x in inside}
        by_rack = " ".join(
            f"when '{k}' then " + _pick(f"{region}/{k}", {str(x.shard): x.weight for x in inside if x.rack == k})
            for k in racks
        )
        by_region.append(f"when '{region}' then case {_pick(region, racks)} {by_rack} end")
    return f"cast(case {_pick('', regions)} {' '.join(by_region)} end as int)"


def sharding(shards: int) -> str:
    """Checksums byte by byte; slots by one window over each shard."""
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ (c & 1) * 0xEDB88320 for c in table]
    bytes_of = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: cast('0x' || h as bigint))"
    fold = f"xor(crc >> 8, ({table})[xor(crc & 255, b) + 1])"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bytes_of}), lambda crc, b: {fold}), 4294967295)"
    return f"""with
        sized as (select doc_id, coalesce(strlen(text), 0) + 1 as size, {crc} as text_crc32,
            coalesce(cast(doc_id as varchar), 'null') as key from documents),
        placed as (select *, {_shard(topology(shards))} as shard, {_shard(topology(shards + 1))} as grown_shard,
            md5(concat_ws(',', key, size, coalesce(text_crc32, -1))) as place from sized)
        select doc_id, size, text_crc32, 'key' as law, shard,
            row_number() over (partition by shard order by place) - 1 as slot, grown_shard from placed"""


def tool_calls() -> str:
    """Exchanges of plain conversations; the tables hold no explicit calls."""
    arguments = """'{' || case when context is null then '' else '"context":' || to_json(context) || ',' end
        || case when text is null then '' else '"prompt":' || to_json(text) || ',' end || '"turn":' || turn || '}'"""
    instructions = """case when text is null then '{}' else '{"instructions":' || to_json(text) || '}' end"""
    blank = "(text is null or not regexp_matches(text, '\\S'))"
    problem = "case when text is null then 'missing {0}' when {1} then 'no string {0}' else '' end"
    written = """'{"arguments":' || c.arguments || ',"id":' || to_json(c.call_id) || ',"name":"' || c.name || '"'
        || case when r.content is null then '' else ',"result":' || to_json(r.content) end || '}'"""
    return f"""with asked as (select m.conv_id, m.turn, 'turn-' || m.conv_id || '-' || m.turn as call_id, m.text,
            case when exists (select 1 from conversations e where e.conv_id = m.conv_id and e.turn = m.turn - 2
            and e.role = 'user') then 'ref:turn-' || m.conv_id || '-' || (m.turn - 2) end as context
            from conversations m where m.role = 'user'),
        calls as (select conv_id, turn, call_id, 'reply' as name, {arguments} as arguments,
            {problem.format('prompt', blank)} as problems from asked
            union all select conv_id, turn, 'turn-' || conv_id || '-' || turn, 'configure', {instructions},
            {problem.format('instructions', blank)} from conversations where role = 'system'),
        results as (select 'turn-' || conv_id || '-' || (turn - 1) as call_id, conv_id, turn, text as content
            from conversations where role = 'assistant'),
        merged as (select call_id, count(*) as n_results,
            arg_min(conv_id, row(turn, content)) as conv_id, min(turn) as turn,
            arg_min(content, row(turn, content)) as content from results group by call_id)
        select c.conv_id, c.turn, c.call_id, c.name, 0 as wave,
            case when r.call_id is null then 'unanswered' else 'linked' end as status, c.problems,
            coalesce(r.n_results, 0) as n_results, {written} as json
            from calls c left join merged r on c.call_id = r.call_id
        union all select conv_id, turn, call_id, null, 0, 'orphan', 'unknown call', n_results,
            '{{"id":' || to_json(call_id) || case when content is null then '' else ',"result":' || to_json(content) end
            || '}}' from merged where call_id not in (select call_id from calls)"""


def collocations(max_words: int, min_count: int, percent: int, first: int) -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " union all ".join(
        f"""select lang, {k} as size, unnest([array_to_string(ws[i:i + {k - 1}], ' ') for i in
            range(1, len(ws) - {k - 2})]) as phrase from split where len(ws) >= {k}"""
        for k in range(1, max_words + 1)
    )
    cuts = " union all ".join(
        f"""select *, {k} as k, array_to_string(string_split(phrase, ' ')[:{k}], ' ') as head,
            array_to_string(string_split(phrase, ' ')[{k + 1}:], ' ') as tail from often where size > {k}"""
        for k in range(1, max_words)
    )
    inner = " union all ".join(
        f"""select lang, a, unnest([array_to_string(string_split(phrase, ' ')[i:i + {k - 1}], ' ') for i in
            range(1, size - {k - 2})]) as phrase from often where size > {k}"""
        for k in range(2, max_words)
    )
    return rf"""with pieces as (select coalesce(lang, 'und') as lang,
            unnest(regexp_split_to_array({lowered}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
        split as materialized (select lang, [w for w in regexp_split_to_array(piece, '[ \t]+') if w <> ''] as ws from pieces),
        counted as materialized (select lang, size, phrase, count(*) as a from ({grams}) g group by 1, 2, 3),
        langs as (select lang, cast(sum(a) as bigint) as n from counted where size = 1 group by lang),
        often as materialized (select * from counted where a >= {min_count}),
        cuts as ({cuts}),
        judged as (select c.lang, c.phrase, c.size, c.a, c.k, l.a as l, r.a as r,
            cast(1000000::hugeint * c.a * c.a // (l.a::hugeint * r.a) as bigint) as score
            from cuts c join often l on l.lang = c.lang and l.phrase = c.head
            join often r on r.lang = c.lang and r.phrase = c.tail),
        weakest as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as rn
            from judged) z where rn = 1),
        covers as (select lang, phrase, max(a) as longer from ({inner or "select lang, a, phrase from often where false"}) i group by 1, 2),
        kept as (select w.* from weakest w left join covers c on c.lang = w.lang and c.phrase = w.phrase
            where c.longer is null or 100 * c.longer < {percent} * w.a),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
        select k.lang, k.rank, k.phrase, k.a, k.l, k.r, g.n, k.score from ranked k join langs g on g.lang = k.lang
        where k.rank <= {first}"""
