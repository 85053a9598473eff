"""Expressions that Spark SQL and the checking engine spell differently."""

from __future__ import annotations


class Spark:
    name = "spark"
    table = staticmethod(lambda t: "{" + t + "}")
    words = staticmethod(lambda x: rf"regexp_extract_all(lower(replace({x}, 'ß', 'ss')), '[\\p{{{{L}}}}\\p{{{{N}}}}_\']+', 0)")
    tokens = staticmethod(lambda x: rf"regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+', 0)")
    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    u64 = staticmethod(lambda h: f"cast(conv(substring({h}, 1, 16), 16, 10) as decimal(20,0))")
    u28 = staticmethod(lambda h: f"cast(conv(substring({h}, 1, 7), 16, 10) as bigint)")
    size = staticmethod(lambda x: f"cast(size({x}) as bigint)")
    bytes = staticmethod(lambda x: f"cast(octet_length({x}) as bigint)")
    distinct = staticmethod(lambda x: f"array_distinct({x})")
    each = staticmethod(lambda x, v, body: f"transform({x}, {v} -> {body})")
    keep = staticmethod(lambda x, v, body: f"filter({x}, {v} -> {body})")
    join = staticmethod(lambda x, s: f"array_join({x}, {s})")
    collapse = staticmethod(lambda x: rf"trim(regexp_replace(lower({x}), '\\s+', ' '))")
    lines = staticmethod(lambda x: rf"filter(transform(split({x}, '\\n'), l -> trim(l)), l -> l <> '')")
    ngrams = staticmethod(lambda w, n: "filter(transform(arrays_zip(" + ", ".join(f"slice({w}, {i + 1}, greatest(size({w}) - {n - 1}, 0))" for i in range(n)) + "), s -> concat_ws(' ', " + ", ".join(f"s.`{i}`" for i in range(n)) + ")), g -> g <> '')")
    ordered = staticmethod(lambda k, v, s: f"array_join(transform(sort_array(collect_list(struct({k} as k, {v} as v))), s -> s.v), {s})")
    json = staticmethod(lambda x, p: f"cast(get_json_object({x}, '$.{p}') as bigint)")
    explode = staticmethod(lambda x: f"explode({x})")
    compact = staticmethod(lambda xs: "array_compact(array(" + ", ".join(xs) + "))")
    div = staticmethod(lambda a, b: f"(({a}) div ({b}))")
    seq = staticmethod(lambda a, b: f"filter(sequence(cast({a} as bigint), greatest(cast({b} as bigint), cast({a} as bigint))), i -> i <= {b})")
    any = staticmethod(lambda x: f"any_value({x})")
    match = staticmethod(lambda x, p: f"{x} rlike '{p}'")
    cap = staticmethod(lambda x: x)
    nul = staticmethod(lambda: "char(0)")


class Duck:
    name = "duck"
    table = staticmethod(lambda t: t)
    words = staticmethod(lambda x: rf"regexp_extract_all(lower(replace({x}, 'ß', 'ss')), '[\p{{L}}\p{{N}}_'']+')")
    tokens = staticmethod(lambda x: rf"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')")
    sha = staticmethod(lambda x: f"sha256({x})")
    u64 = staticmethod(lambda h: f"cast(('0x' || substring({h}, 1, 16))::ubigint as decimal(20,0))")
    u28 = staticmethod(lambda h: f"('0x' || substring({h}, 1, 7))::bigint")
    size = staticmethod(lambda x: f"cast(len({x}) as bigint)")
    bytes = staticmethod(lambda x: f"cast(strlen({x}) as bigint)")
    distinct = staticmethod(lambda x: f"list_distinct({x})")
    each = staticmethod(lambda x, v, body: f"list_transform({x}, lambda {v}: {body})")
    keep = staticmethod(lambda x, v, body: f"list_filter({x}, lambda {v}: {body})")
    join = staticmethod(lambda x, s: f"array_to_string({x}, {s})")
    collapse = staticmethod(lambda x: rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))")
    lines = staticmethod(lambda x: rf"list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(l)), lambda l: l <> '')")
    ngrams = staticmethod(lambda w, n: f"list_transform(range(1, greatest(len({w}) - {n} + 2, 1)), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))")
    ordered = staticmethod(lambda k, v, s: f"string_agg({v}, {s} order by {k})")
    json = staticmethod(lambda x, p: f"cast(json_extract_string({x}, '$.{p}') as bigint)")
    explode = staticmethod(lambda x: f"unnest({x})")
    compact = staticmethod(lambda xs: "list_filter([" + ", ".join(xs) + "], lambda r: r is not null)")
    div = staticmethod(lambda a, b: f"(({a}) // ({b}))")
    seq = staticmethod(lambda a, b: f"range(cast({a} as bigint), cast({b} as bigint) + 1)")
    any = staticmethod(lambda x: f"any_value({x})")
    match = staticmethod(lambda x, p: f"regexp_matches({x}, '{p}')")
    cap = staticmethod(lambda x: f"cast({x} as bigint)")
    nul = staticmethod(lambda: "chr(0)")
