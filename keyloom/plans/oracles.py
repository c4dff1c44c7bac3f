"""SQL of an independent engine for the catalogue's queries."""

from __future__ import annotations

M32, M64 = 0xFFFFFFFF, (1 << 64) - 1


def _rot32(x: str, r: int) -> str:
    return f"(((({x}) << {r}) | (({x}) >> {32 - r})) & {M32}::UBIGINT)"


def _mul32(x: str, c: int) -> str:
    return f"((({x}) * {c}::UBIGINT) & {M32}::UBIGINT)"


def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _byte(hexed: str, i: str) -> str:
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr({hexed}, {at}, 1)) - 1)"
    return f"({digit(f'2 * ({i}) + 1')} * 16 + {digit(f'2 * ({i}) + 2')})::UBIGINT"


def murmur32(key: str, seed: str = "0") -> str:
    """MurmurHash3_x86_32 of a string expression, as BIGINT."""
    hexed, n = f"hex(encode({key}))", f"strlen({key})"
    word = lambda i, k: " + ".join(f"{_byte('hx', f'4 * {i} + {j}')} * {256**j}::UBIGINT" for j in range(k))
    mixed = lambda w: _mul32(_let(_mul32(w, 0xCC9E2D51), "q", _rot32("q", 15)), 0x1B873593)
    step = f"({_let('xor(h, k)', 'x', _rot32('x', 13))} * 5 + {0xE6546B64}::UBIGINT) & {M32}::UBIGINT"
    tail = f"CASE n % 4 WHEN 0 THEN 0::UBIGINT WHEN 1 THEN {mixed(word('(n // 4)', 1))} WHEN 2 THEN {mixed(word('(n // 4)', 2))} ELSE {mixed(word('(n // 4)', 3))} END"
    body = f"list_reduce(list_concat([({seed})::UBIGINT], list_transform(range(0, n // 4), lambda i: {mixed(word('i', 4))})), lambda h, k: {step})"
    mix = "list_transform([xor(xor(b, t), n::UBIGINT)], lambda f: " + _let("xor(f, f >> 16)", "f1", _let(_mul32("f1", 0x85EBCA6B), "f2", _let("xor(f2, f2 >> 13)", "f3", _let(_mul32("f3", 0xC2B2AE35), "f4", "xor(f4, f4 >> 16)")))) + ")[1]"
    return f"(SELECT {mix}::BIGINT FROM (SELECT {body} AS b, {tail} AS t, n FROM (SELECT {hexed} AS hx, {n} AS n)))"


def murmur128_steps(keys: str, seed: int, blocks: int) -> str:
    """CTEs from a table k(key) of at most 16 x blocks bytes a key to m(key, h1, h2), unsigned."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    mul = lambda x, c: f"((({x})::UHUGEINT * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT)"
    add = lambda *x: f"(({' + '.join(f'({y})::UHUGEINT' for y in x)}) % 18446744073709551616::UHUGEINT)"
    rot = lambda x, r: f"({mul(x, 1 << r)} + ({x})::UHUGEINT // {1 << (64 - r)}::UHUGEINT)"
    word = lambda at: " + ".join(f"(CASE WHEN {at} + {j} < n THEN {_byte('hx', f'{at} + {j}')} ELSE 0 END)::UHUGEINT * {256**j}::UHUGEINT" for j in range(8))
    out = [f"k AS ({keys})", f"s0 AS (SELECT key, hex(encode(key)) AS hx, strlen(key) AS n, {seed}::UHUGEINT AS h1, {seed}::UHUGEINT AS h2 FROM k)"]
    for i in range(blocks):
        out += [
            f"w{i} AS (SELECT *, {word(f'{16 * i}')} AS a, {word(f'{16 * i + 8}')} AS b FROM s{i})",
            f"x{i} AS (SELECT * REPLACE ({mul(rot(mul('a', c1), 31), c2)} AS a, {mul(rot(mul('b', c2), 33), c1)} AS b) FROM w{i})",
            f"y{i} AS (SELECT * REPLACE (CASE WHEN n < {16 * i + 16} THEN xor(h1, a) ELSE {add(mul(add(rot('xor(h1, a)', 27), 'h2'), 5), 0x52DCE729)} END AS h1) FROM x{i})",
            f"s{i + 1} AS (SELECT key, hx, n, h1, CASE WHEN n < {16 * i + 16} THEN xor(h2, b) ELSE {add(mul(add(rot('xor(h2, b)', 31), 'h1'), 5), 0x38495AB5)} END AS h2 FROM y{i})",
        ]
    out += [f"f0 AS (SELECT key, {add('xor(h1, n::UHUGEINT)', 'xor(h2, n::UHUGEINT)')} AS h1, xor(h2, n::UHUGEINT) AS h2 FROM s{blocks})", f"f1 AS (SELECT key, h1, {add('h1', 'h2')} AS h2 FROM f0)"]
    for i, c in ((1, 0xFF51AFD7ED558CCD), (2, 0xC4CEB9FE1A85EC53)):
        out.append(f"f{i + 1} AS (SELECT key, {mul(f'xor(h1, h1 // {1 << 33}::UHUGEINT)', c)} AS h1, {mul(f'xor(h2, h2 // {1 << 33}::UHUGEINT)', c)} AS h2 FROM f{i})")
    out += [
        f"f4 AS (SELECT key, xor(h1, h1 // {1 << 33}::UHUGEINT) AS h1, xor(h2, h2 // {1 << 33}::UHUGEINT) AS h2 FROM f3)",
        f"f5 AS (SELECT key, {add('h1', 'h2')} AS h1, h2 FROM f4)",
        f"m AS (SELECT key, h1, {add('h1', 'h2')} AS h2 FROM f5)",
    ]
    return ", ".join(out)


def hex64(x: str) -> str:
    return f"lpad(lower(hex(({x})::UBIGINT)), 16, '0')"


def fanout_parts(size: str = "size", leaf: str = "leaf") -> str:
    """The parts of a split as a list of INTEGER, from integer arithmetic on tenths and hundredths."""
    lower = f"({leaf} * greatest(2, (35 * {leaf} + 50 + 99) // 100))"
    upper = f"({lower} * CASE WHEN {leaf} >= 7 THEN (21 * {leaf} + 90 + 99) // 100 ELSE 2 END)"
    first = f"({upper} * (({size} // 2 + {upper} - 1) // {upper}))"
    part = f"(CASE WHEN {size} > {lower} THEN {lower} ELSE {leaf} END)"
    return f"CASE WHEN {size} <= {leaf} THEN [{size}] WHEN {size} > {upper} THEN [{first}, {size} - {first}] ELSE list_concat(list_transform(range(0, {size} // {part}), lambda i: {part}), CASE WHEN {size} % {part} > 0 THEN [{size} % {part}] ELSE [] END) END"


def golomb_parameter(p: str) -> str:
    return f"CASE WHEN ({p}) >= 1 THEN 0 ELSE greatest(ceil(log2(-ln((1 + sqrt(5)) / 2) / ln(1 - ({p})))), 0) END::INTEGER"
