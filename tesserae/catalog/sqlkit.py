"""Plain SQL statements that state the same results for a second engine (DuckDB dialect).

``Sql`` collects named steps; each method adds the steps of one job.
"""

from __future__ import annotations

from ..functions.backup import STEPS_A, STEPS_C, VARIANT_CODE, WIDTHS_C
from ..functions.pixels import budget
from ..sources.carriers import PAGE_ROWS
from ..sources.keyring import TEST_KEYS, keyring_rows, test_key

HEXDIGITS = "'0123456789ABCDEF'"


def be(value: str, width: int) -> str:
    return f"unhex(lpad(hex(({value})::BIGINT), {2 * width}, '0'))"


def prefixed_text(text: str) -> str:
    return f"unhex(lpad(hex(octet_length(encode({text}))::BIGINT), 4, '0')) || encode({text})"


def netstring(text: str) -> str:
    return f"octet_length(encode({text}))::VARCHAR || ':' || {text}"


def hmac(kind: str, message: str) -> str:
    return f"sha256({kind}_out || unhex(sha256({kind}_in || {message})))"


def to_bytes(values: str) -> str:
    return f"unhex(array_to_string(list_transform({values}, lambda b: lpad(hex(b::BIGINT), 2, '0')), ''))"


def from_hex(text: str, n: str | int) -> str:
    """Hex text (any case) -> list of n byte values."""
    return (
        f"list_transform(range({n}), lambda j: ((instr({HEXDIGITS}, substr(upper({text}), (2*j+1)::INT, 1)) - 1) * 16"
        f" + instr({HEXDIGITS}, substr(upper({text}), (2*j+2)::INT, 1)) - 1)::INT)"
    )


def msb_bytes(px: str) -> str:
    return to_bytes(f"list_transform({px}, lambda v: v & 252)")


def seed(*parts: str) -> str:
    joined = " || '|' || ".join(parts)
    return f"('0x' || substr(sha256({joined}), 1, 15))::BIGINT"


def fraction(digest: str) -> str:
    return f"(('0x' || substr({digest}, 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0"


def uniform(seed_col: str, label: str) -> str:
    return fraction(f"sha256({seed_col}::VARCHAR || '|{label}')")


def noise(seed_col: str, owner: str, ch: str, idx: str, n: int = 64) -> str:
    base = f"{seed_col}::VARCHAR || '|' || {owner} || '|' || {ch} || '|' || {idx}"
    return from_hex(f"(sha256({base} || '|0') || sha256({base} || '|1'))", n)


def half_even(value: str) -> str:
    return f"round_even(round({value}, 9), 0)"


def psnr(sum_sq: str, n: str) -> str:
    return (
        f"CASE WHEN {n} = 0 THEN 'nan'::DOUBLE WHEN {sum_sq} = 0 THEN 'inf'::DOUBLE "
        f"ELSE 10.0 * log10(65025.0::DOUBLE * {n} / {sum_sq}) END"
    )


def sq_err(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(len({a})), lambda z: (({a}[z+1] - {b}[z+1]) * ({a}[z+1] - {b}[z+1]))::BIGINT))::BIGINT"


GEO = "owner_id, key_id, stem, label, page, height, width, block, k, ncols, ch, idx, r, c"
GRID = "owner_id, key_id, height, width, block, k, ncols, idx, r, c"


class Sql:
    def __init__(self):
        self.steps: dict[str, str] = {}

    def add(self, name: str, body: str) -> "Sql":
        self.steps[name] = body
        return self

    def select(self, body: str) -> str:
        if not self.steps:
            return body
        ctes = ",\n".join(f"{n} AS ({b})" for n, b in self.steps.items())
        return f"WITH {ctes}\n{body}"

    # -- inputs --------------------------------------------------------------

    def keyring(self) -> "Sql":
        rows = keyring_rows({i: test_key(i) for i in range(TEST_KEYS)})
        values = ", ".join("(" + str(r[0]) + ", " + ", ".join(f"unhex('{b.hex()}')" for b in r[1:]) + ")" for r in rows)
        return self.add("keyring", f"SELECT * FROM (VALUES {values}) t(key_id, tag_in, tag_out, map_in, map_out)")

    def vectors(self, name: str = "fa", channels: int = 1, ncols: int = 6) -> "Sql":
        self.add(
            f"{name}_q",
            "SELECT vec_id, label, list_transform(embedding, lambda e: greatest(0, least(255, "
            "round_even((e::DOUBLE + 0.5) * 255, 0)::INT))::INT) AS px, "
            "row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n "
            "FROM embeddings",
        )
        rows = PAGE_ROWS * ncols
        self.add(
            f"{name}_p",
            f"SELECT *, pos // {channels} // {rows} AS page, pos % {channels} AS ch, pos // {channels} % {rows} AS idx, "
            f"least({rows}, n // {channels} - pos // {channels} // {rows} * {rows}) AS inpage FROM {name}_q",
        )
        return self.add(
            name,
            f"""SELECT 'vec' || label || 'p' || page || '|' || ((inpage // {ncols}) * 8) || 'x{ncols * 8}|8' AS owner_id,
                label % 5 AS key_id, 'vec' || label || 'p' || page AS stem, label, page,
                (inpage // {ncols}) * 8 AS height, {ncols * 8} AS width, 8 AS block, inpage - inpage % {ncols} AS k,
                {ncols} AS ncols, ch, idx, idx // {ncols} AS r, idx % {ncols} AS c, px
                FROM {name}_p WHERE idx < inpage - inpage % {ncols}""",
        )

    def split4(self, src: str, name: str) -> "Sql":
        return self.add(
            name,
            f"""SELECT stem || '|' || height || 'x' || width || '|4' AS owner_id, key_id, stem, label, page, height, width,
                4 AS block, k * 4 AS k, ncols * 2 AS ncols, ch, (r * 2 + qy) * ncols * 2 + c * 2 + qx AS idx,
                r * 2 + qy AS r, c * 2 + qx AS c,
                list_transform(range(16), lambda i: px[((i // 4 + qy * 4) * 8 + i % 4 + qx * 4 + 1)::INT]) AS px
                FROM {src}, (VALUES (0,0),(0,1),(1,0),(1,1)) q(qy, qx)""",
        )

    # -- backups -------------------------------------------------------------

    def basis(self, block: int) -> "Sql":
        b = block
        self.add(
            f"zz{b}",
            f"SELECT u, v, row_number() OVER (ORDER BY u + v, CASE WHEN (u + v) % 2 = 1 THEN u ELSE v END) - 1 AS z "
            f"FROM range({b}) a(u), range({b}) bb(v)",
        )
        norm = lambda q: f"(CASE WHEN {q} = 0 THEN sqrt(1.0 / {b}) ELSE sqrt(2.0 / {b}) END)"
        return self.add(
            f"basis{b}",
            f"SELECT z, y * {b} + x AS p, {norm('u')} * {norm('v')} * cos(pi() * (2 * y + 1) * u / {2 * b}) "
            f"* cos(pi() * (2 * x + 1) * v / {2 * b}) AS w FROM zz{b}, range({b}) yy(y), range({b}) xx(x)",
        )

    def coefficients(self, src: str, name: str, block: int = 8, px: str = "px", keys: str = "owner_id, ch, idx") -> "Sql":
        """Zig-zag coefficient list per block of the six upper planes."""
        self.basis(block)
        self.add(
            f"{name}_u",
            f"SELECT {keys}, unnest(range({block * block})) AS p, unnest({px}) AS v FROM {src}",
        )
        self.add(
            f"{name}_z",
            f"SELECT {keys}, z, sum(((v & 252) - 128) * w) AS coef FROM {name}_u JOIN basis{block} USING (p) GROUP BY ALL",
        )
        return self.add(name, f"SELECT {keys}, list(coef ORDER BY z) AS coef FROM {name}_z GROUP BY ALL")

    def inverse(self, src: str, name: str, block: int, coef: str, keys: str) -> "Sql":
        """Pixels (low bits cleared) from a list of leading coefficients."""
        self.basis(block)
        self.add(f"{name}_u", f"SELECT {keys}, unnest(range(len({coef}))) AS z, unnest({coef}) AS q FROM {src}")
        self.add(
            f"{name}_p",
            f"SELECT {keys}, p, sum(q * w) + 128.0 AS v FROM {name}_u JOIN basis{block} USING (z) GROUP BY ALL",
        )
        return self.add(
            name,
            f"SELECT {keys}, list(greatest(0, least(255, {half_even('v')}::INT)) & 252 ORDER BY p) AS dpx "
            f"FROM {name}_p GROUP BY ALL",
        )

    def backup(self, src: str, name: str, variant: str, block: int = 8, px: str = "px", keys: str = "owner_id, ch, idx") -> "Sql":
        """(keys, bkp) for every block of src."""
        if variant == "A":
            n = budget(block)[2] // 8
            self.coefficients(src, f"{name}_c", block, px, keys)
            steps = "[" + ", ".join(f"{s}.0" for s in STEPS_A[:n]) + "]"
            codes = (
                f"list_transform(range({n}), lambda i: greatest(-128, least(127, "
                f"{half_even(f'coef[(i+1)::INT] / {steps}[(i+1)::INT]')}::INT)) & 255)"
            )
            return self.add(name, f"SELECT {keys}, {to_bytes(codes)} AS bkp FROM {name}_c")
        if variant == "B":
            half, b = block // 2, block
            at = lambda dy, dx: f"({px}[((q // {half} * 2 + {dy}) * {b} + q % {half} * 2 + {dx} + 1)::INT] & 252)"
            mean = f"(({at(0, 0)} + {at(0, 1)} + {at(1, 0)} + {at(1, 1)}) // 4)"
            if block == 8:
                cells = f"list_transform(range(16), lambda q: {mean} >> 2)"
                packed = (
                    "list_transform(range(4), lambda g: lpad(hex((m[(4*g+1)::INT] * 262144 + m[(4*g+2)::INT] * 4096 "
                    "+ m[(4*g+3)::INT] * 64 + m[(4*g+4)::INT])::BIGINT), 6, '0'))"
                )
            else:
                cells = f"list_transform(range(4), lambda q: {mean} >> 4)"
                packed = "list_transform(m, lambda z: hex(z::BIGINT))"
            return self.add(
                name,
                f"SELECT {keys}, unhex(array_to_string({packed}, '')) AS bkp FROM "
                f"(SELECT {keys}, {cells} AS m FROM {src})",
            )
        return self.modes(src, f"{name}_m", px, keys).add(name, f"SELECT {keys}, bkp FROM {name}_m")

    def modes(self, src: str, name: str, px: str = "px", keys: str = "owner_id, ch, idx") -> "Sql":
        """Variant C: both tables tried per block -> (keys, mode, err0, err1, saturated, bkp)."""
        self.coefficients(src, f"{name}_c", 8, px, keys)
        rows, offset = [], [1, 1]
        for m in (0, 1):
            for z, (w, s) in enumerate(zip(WIDTHS_C[m], STEPS_C[m])):
                if w:
                    rows.append(f"({m}, {z}, {w}, {s}, {offset[m]})")
                    offset[m] += w
        self.add("ctable", f"SELECT * FROM (VALUES {', '.join(rows)}) t(mode, z, width, step, off)")
        self.add(
            f"{name}_q",
            f"SELECT {keys}, mode, z, width, step, off, {half_even('coef / step')}::BIGINT AS raw, "
            f"greatest(-(1 << (width - 1)), least((1 << (width - 1)) - 1, {half_even('coef / step')}::BIGINT)) AS q "
            f"FROM {name}_c_z JOIN ctable USING (z)",
        )
        self.add(
            f"{name}_r",
            f"SELECT {keys}, mode, p, greatest(0, least(255, {half_even('sum(q * step * w) + 128.0')}::INT)) & 252 AS v "
            f"FROM {name}_q JOIN basis8 USING (z) GROUP BY {keys}, mode, p",
        )
        self.add(
            f"{name}_e",
            f"SELECT {keys}, mode, sum((a.v - (b.v & 252)) * (a.v - (b.v & 252)))::BIGINT AS err FROM {name}_r a "
            f"JOIN {name}_c_u b USING ({keys}, p) GROUP BY ALL",
        )
        self.add(
            f"{name}_b",
            f"SELECT {keys}, mode, count_if(raw <> q)::BIGINT AS saturated, string_agg(lpad(bin((CASE WHEN q < 0 THEN q + (1 << width) "
            f"ELSE q END)::BIGINT), width, '0'), '' ORDER BY z) AS bits FROM {name}_q GROUP BY ALL",
        )
        hexes = (
            "array_to_string(list_transform(range(24), lambda i: substr('0123456789abcdef', ("
            "(substr(b, (4*i+1)::INT, 1)::INT * 8 + substr(b, (4*i+2)::INT, 1)::INT * 4 "
            "+ substr(b, (4*i+3)::INT, 1)::INT * 2 + substr(b, (4*i+4)::INT, 1)::INT) + 1)::INT, 1)), '')"
        )
        return self.add(
            name,
            f"SELECT {keys}, mode, err0, err1, saturated, unhex({hexes}) AS bkp FROM (SELECT {keys}, "
            f"CASE WHEN e1.err < e0.err THEN 1 ELSE 0 END AS mode, e0.err AS err0, e1.err AS err1, "
            f"CASE WHEN e1.err < e0.err THEN b1.saturated ELSE b0.saturated END AS saturated, "
            f"CASE WHEN e1.err < e0.err THEN '1' || b1.bits ELSE '0' || b0.bits END AS b "
            f"FROM (SELECT * FROM {name}_e WHERE mode = 0) e0 JOIN (SELECT * FROM {name}_e WHERE mode = 1) e1 USING ({keys}) "
            f"JOIN (SELECT * FROM {name}_b WHERE mode = 0) b0 USING ({keys}) JOIN (SELECT * FROM {name}_b WHERE mode = 1) b1 USING ({keys}))",
        )

    def decoded(self, src: str, name: str, variant: str, block: int = 8, bkp: str = "bkp", keys: str = "owner_id, ch, idx") -> "Sql":
        """(keys, dpx): pixels rebuilt from backup bytes."""
        n_bytes = budget(block)[2] // 8
        if variant == "A":
            steps = "[" + ", ".join(f"{s}.0" for s in STEPS_A[:n_bytes]) + "]"
            values = from_hex(f"hex({bkp})", n_bytes)
            coef = (
                f"list_transform(range({n_bytes}), lambda i: (CASE WHEN bv[(i+1)::INT] >= 128 THEN bv[(i+1)::INT] - 256 "
                f"ELSE bv[(i+1)::INT] END)::DOUBLE * {steps}[(i+1)::INT])"
            )
            self.add(f"{name}_s", f"SELECT {keys}, {coef} AS cc FROM (SELECT {keys}, {values} AS bv FROM {src})")
            return self.inverse(f"{name}_s", name, block, "cc", keys)
        if variant == "B":
            half, b = block // 2, block
            if block == 8:
                # 3 bytes hold 4 six-bit means
                cell = (
                    "((bv[(q//4*3+1)::INT] * 65536 + bv[(q//4*3+2)::INT] * 256 + bv[(q//4*3+3)::INT]) >> (18 - 6 * (q % 4))::INT) & 63"
                )
                up, mid = 4, 2
            else:
                cell = "(bv[(q//2+1)::INT] >> (4 - 4 * (q % 2))::INT) & 15"
                up, mid = 16, 8
            return self.add(
                name,
                f"SELECT {keys}, list_transform(range({b * b}), lambda p: (cv[((p // {b} // 2) * {half} + p % {b} // 2 + 1)::INT] "
                f"* {up} + {mid}) & 252) AS dpx FROM (SELECT {keys}, list_transform(range({half * half}), lambda q: ({cell})::INT) AS cv "
                f"FROM (SELECT {keys}, {from_hex(f'hex({bkp})', n_bytes)} AS bv FROM {src}))",
            )
        raise ValueError(variant)

    # -- seal, verify, repair ------------------------------------------------

    def map(self, src: str, name: str, keys: str = "owner_id", plain: bool = False) -> "Sql":
        """Keyed cycle: (owner_id, idx, holder, carries); between strips of the raster order unless plain."""
        message = (
            f"{be('height', 2)} || {be('width', 2)} || {be('block', 2)} || {be('k', 4)} || {prefixed_text('owner_id')} || {be('idx', 4)}"
        )
        self.add(
            f"{name}_h",
            f"SELECT {keys}, idx, k, ncols, block, height, width, {hmac('map', message)} AS h "
            f"FROM {src} JOIN keyring USING (key_id) WHERE ch = 0",
        )
        source, order = f"{name}_h", "h, idx"
        if not plain:
            self.add(f"{name}_g", f"SELECT *, k % 2 = 1 AND k > 1 AS odd, (greatest(k - k % 2, 2) - 2) // 2 // 2 AS b, (greatest(k - k % 2, 2) - 2) // 2 - (greatest(k - k % 2, 2) - 2) // 2 // 2 AS a FROM {name}_h")
            self.add(f"{name}_i", f"SELECT *, CASE WHEN odd AND idx = a + b + 1 THEN NULL WHEN odd AND idx > a + b + 1 THEN idx - 1 ELSE idx END AS spot FROM {name}_g")
            self.add(f"{name}_b", f"SELECT *, CASE WHEN spot IS NULL THEN 'middle' WHEN spot <= a THEN 'first' WHEN spot <= a + b THEN 'second' WHEN spot <= 2 * a + b THEN 'third' ELSE 'fourth' END AS strip FROM {name}_i")
            turn = "CASE WHEN odd AND idx = 0 THEN 1 WHEN odd AND idx = k - 1 THEN -1 ELSE 0 END"
            self.add(f"{name}_j", f"SELECT *, row_number() OVER (PARTITION BY {keys}, strip ORDER BY {turn}, h, idx) - 1 AS j FROM {name}_b")
            self.add(
                f"{name}_o",
                f"SELECT *, CASE strip WHEN 'first' THEN 2 * j WHEN 'third' THEN 2 * j + 1 WHEN 'middle' THEN 2 * a + 1 WHEN 'fourth' THEN 2 * a + 1 + odd::INT + 2 * j ELSE 2 * a + 2 + odd::INT + 2 * j END AS place FROM {name}_j",
            )
            source, order = f"{name}_o", "place"
        w = f"PARTITION BY {keys} ORDER BY {order}"
        full = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
        return self.add(
            name,
            f"SELECT {keys}, idx, k, ncols, block, height, width, h, coalesce(lead(idx) OVER ({w}), first_value(idx) OVER ({w} {full})) AS holder, "
            f"coalesce(lag(idx) OVER ({w}), last_value(idx) OVER ({w} {full})) AS carries FROM {source}",
        )

    def tag(self, variant: str, block: int, px: str, carried: str | None, owner: str = "owner_id") -> str:
        mark = "WGT2" if carried else "WGT1"
        message = (
            f"encode('{mark}') || {be('height', 2)} || {be('width', 2)} || {be(str(block), 2)} || {be('ch', 1)} || "
            f"{be(str(VARIANT_CODE[variant]), 1)} || {be('idx', 4)} || {prefixed_text(owner)} || {msb_bytes(px)}"
        )
        if carried:
            message += f" || {carried}"
        return f"substr({hmac('tag', message)}, 1, {budget(block)[1] // 4})"

    def seal(self, src: str, name: str, variant: str, block: int = 8, bound: bool = True, keys: str = "owner_id") -> "Sql":
        full = f"{keys}, ch, idx"
        self.map(src, f"{name}_map", keys).backup(src, f"{name}_d", variant, block, keys=full)
        self.add(
            f"{name}_c",
            f"SELECT s.*, d.bkp, m.holder, m.carries, e.bkp AS carried FROM {src} s JOIN {name}_d d USING ({full}) "
            f"JOIN (SELECT {keys}, idx, holder, carries FROM {name}_map) m USING ({keys}, idx) "
            f"JOIN (SELECT {keys}, ch, idx AS carries, bkp FROM {name}_d) e USING ({keys}, ch, carries)",
        )
        self.add(
            f"{name}_t",
            f"SELECT s.*, {self.tag(variant, block, 'px', 'carried' if bound else None)} AS tag FROM {name}_c s JOIN keyring USING (key_id)",
        )
        nibble = f"(instr({HEXDIGITS}, substr(upper(tag || hex(carried)), ((i-1)//2+1)::INT, 1)) - 1)"
        pair = f"(CASE WHEN (i-1) % 2 = 0 THEN {nibble} >> 2 ELSE {nibble} & 3 END)"
        return self.add(
            name,
            f"SELECT * EXCLUDE (px), px, '{variant}' AS variant, list_transform(px, lambda v, i: ((v & 252) | {pair})::INT) AS px_sealed FROM {name}_t",
        )

    def received(self, src: str, name: str) -> "Sql":
        return self.add(name, f"SELECT * EXCLUDE (px, bkp, holder, carries, carried, tag, px_sealed), px_sealed AS px FROM {src}")

    def check(self, src: str, name: str, variant: str, block: int = 8, bound: bool = True) -> "Sql":
        n_tag, n_desc = budget(block)[1] // 8, budget(block)[2] // 8
        low = to_bytes(
            f"list_transform(range({block * block // 4}), lambda q: (px[(4*q+1)::INT] & 3) * 64 + (px[(4*q+2)::INT] & 3) * 16 "
            "+ (px[(4*q+3)::INT] & 3) * 4 + (px[(4*q+4)::INT] & 3))"
        )
        self.add(f"{name}_l", f"SELECT *, hex({low}) AS low FROM {src}")
        self.add(
            f"{name}_s",
            f"SELECT * EXCLUDE (low), lower(substr(low, 1, {2 * n_tag})) AS stored_tag, unhex(substr(low, {2 * n_tag + 1}, {2 * n_desc})) AS stored_desc FROM {name}_l",
        )
        fresh = self.tag(variant, block, "px", "stored_desc" if bound else None)
        self.add(f"{name}_f", f"SELECT s.*, {fresh} AS fresh_tag FROM {name}_s s JOIN keyring USING (key_id)")
        return self.add(name, f"SELECT *, stored_tag <> fresh_tag AS mismatch FROM {name}_f")

    def flags(self, src: str, name: str, extra: str = "") -> "Sql":
        return self.add(name, f"SELECT {extra}{GRID}, bool_or(mismatch) AS raw FROM {src} GROUP BY ALL")

    def refine(self, src: str, name: str, extra: str = "", clear: bool = False) -> "Sql":
        using = f"{extra}owner_id".replace(" ", "")
        on = " AND ".join(f"a.{k} = b.{k}" for k in using.split(","))
        self.add(
            f"{name}_n",
            f"SELECT a.*, b.raw AS nraw FROM {src} a LEFT JOIN {src} b ON {on} AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 "
            "AND (a.r <> b.r OR a.c <> b.c)",
        )
        self.add(
            f"{name}_s",
            f"SELECT {extra}{GRID}, raw, count_if(nraw)::BIGINT AS s, count(nraw) AS nvalid FROM {name}_n GROUP BY ALL",
        )
        kept = "(raw AND s > 0)" if clear else "raw"
        return self.add(
            name,
            f"SELECT *, ceil(7.0 * nvalid / 8)::BIGINT AS needed, ({kept} OR (NOT raw AND s >= ceil(7.0 * nvalid / 8))) AS flagged FROM {name}_s",
        )

    def localize(self, src: str, name: str, extra: str = "", refined: bool = True) -> "Sql":
        self.flags(src, f"{name}_raw", extra)
        if refined:
            return self.refine(f"{name}_raw", name, extra)
        return self.add(name, f"SELECT *, raw AS flagged FROM {name}_raw")

    def state(self, checked: str, mask: str, pmap: str, name: str, extra: str = "", map_keys: str = "owner_id") -> "Sql":
        """Per block and channel: own backup read from the holder, the holder's flag, recoverability."""
        ex = extra.replace(" ", "").rstrip(",")
        ex_list = ex.split(",") if ex else []
        k = ", ".join(ex_list + ["owner_id", "idx"])
        kc = ", ".join(ex_list + ["owner_id", "ch", "idx"])
        eh = ", ".join(ex_list + ["owner_id"])
        return self.add(
            name,
            f"SELECT c.*, m.raw, m.flagged, p.holder, d.own_desc, hf.holder_flagged, m.flagged AND NOT hf.holder_flagged AS recoverable, "
            f"m.flagged AND hf.holder_flagged AS unrecoverable FROM {checked} c JOIN (SELECT {k}, raw, flagged FROM {mask}) m USING ({k}) "
            f"JOIN (SELECT {map_keys}, idx, holder FROM {pmap}) p USING ({map_keys}, idx) "
            f"JOIN (SELECT {eh}, ch, idx AS holder, stored_desc AS own_desc FROM {checked}) d USING ({eh}, ch, holder) "
            f"JOIN (SELECT {eh}, idx AS holder, flagged AS holder_flagged FROM {mask}) hf USING ({eh}, holder)",
        )

    def mask_state(self, mask: str, pmap: str, name: str, extra: str = "", map_keys: str = "owner_id") -> "Sql":
        ex = extra.replace(" ", "").rstrip(",")
        eh = ", ".join((ex.split(",") if ex else []) + ["owner_id"])
        return self.add(
            name,
            f"SELECT m.*, p.holder, hf.holder_flagged, m.flagged AND NOT hf.holder_flagged AS recoverable, "
            f"m.flagged AND hf.holder_flagged AS unrecoverable FROM {mask} m "
            f"JOIN (SELECT {map_keys}, idx, holder FROM {pmap}) p USING ({map_keys}, idx) "
            f"JOIN (SELECT {eh}, idx AS holder, flagged AS holder_flagged FROM {mask}) hf USING ({eh}, holder)",
        )

    def repaired(self, state: str, name: str, variant: str, block: int = 8, keys: str = "owner_id, ch, idx") -> "Sql":
        self.add(f"{name}_rec", f"SELECT {keys}, own_desc AS bkp FROM {state} WHERE recoverable")
        self.decoded(f"{name}_rec", f"{name}_dec", variant, block, keys=keys)
        return self.add(
            name,
            f"SELECT s.*, CASE WHEN recoverable THEN dpx WHEN unrecoverable THEN list_transform(px, lambda v: 0) ELSE px END AS px_repaired "
            f"FROM {state} s LEFT JOIN {name}_dec USING ({keys})",
        )

    # -- damage --------------------------------------------------------------

    def region(self, src: str, name: str, cls: str, ratio: str, base: str = "20260811") -> "Sql":
        """Adds seed, y0, x0, y1, x1 and truth_px (list<boolean>) to every block."""
        self.add(f"{name}_s", f"SELECT *, {seed(repr(base), 'stem', cls, ratio)} AS seed, ({ratio})::DOUBLE AS rr FROM {src}")
        self.add(
            f"{name}_a",
            f"SELECT *, pow(2.0, 2.0 * {uniform('seed', 'aspect')} - 1.0) AS aspect FROM {name}_s",
        )
        self.add(
            f"{name}_z",
            f"SELECT *, greatest(1, least(height, round_even(sqrt(rr * height * width / aspect), 0)::BIGINT)) AS rh, "
            f"greatest(1, least(width, round_even(sqrt(rr * height * width * aspect), 0)::BIGINT)) AS rw FROM {name}_a",
        )
        self.add(
            f"{name}_y",
            f"SELECT *, floor({uniform('seed', 'y')} * (height - rh + 1))::BIGINT AS y0, "
            f"floor({uniform('seed', 'x')} * (width - rw + 1))::BIGINT AS x0 FROM {name}_z",
        )
        self.add(f"{name}_x", f"SELECT *, y0 + rh AS y1, x0 + rw AS x1 FROM {name}_y")
        inside = (
            "(r * block + p // block >= y0 AND r * block + p // block < y1 AND c * block + p % block >= x0 AND c * block + p % block < x1)"
        )
        return self.add(
            name,
            f"SELECT * EXCLUDE (rr, aspect, rh, rw), list_transform(range(block * block), lambda p: {inside}) AS truth_px FROM {name}_x",
        )

    def noised(self, src: str, name: str, block: int = 8) -> "Sql":
        """px replaced by hashed bytes inside truth_px; the former pixels stay as px_before."""
        return self.add(
            name,
            f"SELECT * EXCLUDE (px), px AS px_before, list_transform(range(len(px)), lambda i: CASE WHEN truth_px[(i+1)::INT] "
            f"THEN nz[(i+1)::INT] ELSE px[(i+1)::INT] END) AS px FROM (SELECT *, {noise('seed', 'owner_id', 'ch', 'idx', block * block)} AS nz FROM {src})",
        )

    # -- scores --------------------------------------------------------------

    def ssim(self, src: str, name: str, a: str, b: str, keys: str = "owner_id", truth: str = "NULL", keep: str = "TRUE") -> "Sql":
        """Window sums in two passes over exploded pixels."""
        self.add(
            f"{name}_u",
            f"SELECT {keys}, ch, r, c, height, width, block, {keep} AS keep, unnest(range(block * block)) AS p, unnest({a}) AS a, "
            f"unnest({b}) AS b, {'unnest(' + truth + ')' if truth != 'NULL' else 'FALSE'} AS t FROM {src}",
        )
        self.add(
            f"{name}_y",
            f"SELECT {keys}, ch, height, width, keep, t, r * block + p // block AS y, c * block + p % block AS x, a::BIGINT AS a, b::BIGINT AS b FROM {name}_u",
        )
        row = f"(PARTITION BY {keys}, ch, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
        col = f"(PARTITION BY {keys}, ch, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
        self.add(
            f"{name}_h",
            f"SELECT {keys}, ch, y, x, height, width, keep, t, sum(a) OVER {row} AS sa, sum(b) OVER {row} AS sb, "
            f"sum(a * a) OVER {row} AS saa, sum(b * b) OVER {row} AS sbb, sum(a * b) OVER {row} AS sab FROM {name}_y",
        )
        self.add(
            f"{name}_v",
            f"SELECT {keys}, ch, y, x, height, width, keep, t, (sum(sa) OVER {col})::DOUBLE AS sa, (sum(sb) OVER {col})::DOUBLE AS sb, "
            f"(sum(saa) OVER {col})::DOUBLE AS saa, (sum(sbb) OVER {col})::DOUBLE AS sbb, (sum(sab) OVER {col})::DOUBLE AS sab FROM {name}_h",
        )
        self.add(
            f"{name}_s",
            f"SELECT {keys}, keep, t, ((2 * (sa / 49) * (sb / 49) + 6.5025) * (2 * (49 * sab - sa * sb) / 2352 + 58.5225)) / "
            "(((sa / 49) * (sa / 49) + (sb / 49) * (sb / 49) + 6.5025) * ((49 * saa - sa * sa) / 2352 + (49 * sbb - sb * sb) / 2352 + 58.5225)) AS s "
            f"FROM {name}_v WHERE y >= 3 AND y < height - 3 AND x >= 3 AND x < width - 3",
        )
        nan = "'nan'::DOUBLE"
        return self.add(
            name,
            f"SELECT {keys}, avg(s) AS ssim, coalesce(avg(s) FILTER (WHERE t AND keep), {nan}) AS ssim_in_region, "
            f"coalesce(avg(s) FILTER (WHERE t), {nan}) AS ssim_pessimistic FROM {name}_s GROUP BY ALL",
        )

    def confusion(self, src: str, name: str, keys: str = "owner_id") -> "Sql":
        parts = []
        for level, pred in (("raw", "raw"), ("block", "flagged")):
            for cell, cond in (("tp", f"{pred} AND hit > 0"), ("fp", f"{pred} AND hit = 0"), ("fn", f"NOT {pred} AND hit > 0"), ("tn", f"NOT {pred} AND hit = 0")):
                parts.append(f"count_if({cond})::BIGINT AS {level}_{cell}")
        for cell, cond, what in (("tp", "flagged", "hit"), ("fp", "flagged", "n - hit"), ("fn", "NOT flagged", "hit"), ("tn", "NOT flagged", "n - hit")):
            parts.append(f"sum(CASE WHEN {cond} THEN {what} ELSE 0 END)::BIGINT AS px_{cell}")
        return self.add(
            name,
            f"SELECT {keys}, {', '.join(parts)} FROM (SELECT *, len(truth_px) AS n, len(list_filter(truth_px, lambda t: t)) AS hit "
            f"FROM {src} WHERE ch = 0) GROUP BY ALL",
        )

    def fidelity_sums(self, src: str, name: str, keys: str = "owner_id") -> "Sql":
        inside = (
            "list_sum(list_transform(range(len(px)), lambda z: CASE WHEN truth_px[z+1] THEN "
            "((px_before[z+1] - px_repaired[z+1]) * (px_before[z+1] - px_repaired[z+1]))::BIGINT ELSE 0::BIGINT END))"
        )
        self.add(
            f"{name}_b",
            f"SELECT {keys}, ch, unrecoverable, len(px) AS n, len(list_filter(truth_px, lambda t: t)) AS hit, "
            f"{sq_err('px_before', 'px_repaired')} AS whole, {sq_err('px_before', 'px')} AS leftover, {inside} AS inside FROM {src}",
        )
        return self.add(
            name,
            f"SELECT {keys}, sum(n)::BIGINT AS n_all, sum(whole)::BIGINT AS sq_marked, "
            "sum(CASE WHEN unrecoverable THEN leftover ELSE whole END)::BIGINT AS sq_unmarked, "
            "sum(CASE WHEN unrecoverable THEN 0 ELSE inside END)::BIGINT AS sq_opt, sum(CASE WHEN unrecoverable THEN 0 ELSE hit END)::BIGINT AS n_opt, "
            "sum(inside)::BIGINT AS sq_pes, sum(hit)::BIGINT AS n_pes, sum(CASE WHEN ch = 0 THEN hit ELSE 0 END)::BIGINT AS n_tampered_px, "
            f"sum(CASE WHEN ch = 0 AND unrecoverable THEN n ELSE 0 END)::BIGINT AS n_unrecoverable_px FROM {name}_b GROUP BY ALL",
        )

    # -- more damage ---------------------------------------------------------

    def preset(self, src: str, name: str, kind: str, ratio: str, base: str = "20260811") -> "Sql":
        self.add(f"{name}_s", f"SELECT *, {seed(repr(base), 'stem', repr(kind), repr(ratio))} AS seed, "
                 f"least(greatest(1, round_even(sqrt({ratio} * height * width), 0)::BIGINT), height, width) AS size FROM {src}")
        if kind == "corner":
            y0 = x0 = "0"
        else:
            y0, x0 = "greatest(0, height // 2 - size // 2)", "greatest(0, width // 2 - size // 2)"
        self.add(f"{name}_y", f"SELECT *, {y0} AS y0, {x0} AS x0 FROM {name}_s")
        self.add(f"{name}_x", f"SELECT * EXCLUDE (size), least(height, y0 + size) AS y1, least(width, x0 + size) AS x1 FROM {name}_y")
        inside = "(r * block + p // block >= y0 AND r * block + p // block < y1 AND c * block + p % block >= x0 AND c * block + p % block < x1)"
        return self.add(name, f"SELECT *, list_transform(range(block * block), lambda p: {inside}) AS truth_px FROM {name}_x")

    def splice_sources(self, src: str, name: str) -> "Sql":
        w = "PARTITION BY height, width ORDER BY label, page"
        full = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
        return self.add(
            name,
            f"SELECT owner_id, stem, height, width, CASE WHEN nx <> owner_id THEN nx END AS source_id FROM (SELECT *, "
            f"coalesce(lead(owner_id) OVER ({w}), first_value(owner_id) OVER ({w} {full})) AS nx FROM {src} WHERE idx = 0 AND ch = 0)",
        )

    def spliced(self, src: str, name: str, sources: str, donors: str, ratio: str, keys: str = "owner_id", same: str = "") -> "Sql":
        """Pixel by pixel: the source pixel at the same place, or mirrored through the centre."""
        self.region(src, f"{name}_g", "'splice'", ratio)
        self.add(
            f"{name}_u",
            f"SELECT {keys}, {same}g.ch, g.idx, p, coalesce(source_id, owner_id) AS from_id, ncols, "
            "r * block + p // block + CASE WHEN source_id IS NULL THEN height - y1 - y0 ELSE 0 END AS sy, "
            "c * block + p % block + CASE WHEN source_id IS NULL THEN width - x1 - x0 ELSE 0 END AS sx, block "
            f"FROM (SELECT *, unnest(range(block * block)) AS p, unnest(truth_px) AS t FROM {name}_g) g "
            f"LEFT JOIN (SELECT owner_id, source_id FROM {sources}) USING (owner_id) WHERE t",
        )
        on = " AND ".join(f"a.{s.strip()} = b.{s.strip()}" for s in same.split(",") if s.strip())
        bare = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
        self.add(
            f"{name}_v",
            f"SELECT {bare}, a.ch, a.idx, list(struct_pack(p := p, v := b.px[((sy % a.block) * a.block + sx % a.block + 1)::INT])) AS fills FROM {name}_u a JOIN "
            f"(SELECT owner_id AS from_id, {same}ch, idx, px FROM {donors}) b ON a.from_id = b.from_id AND a.ch = b.ch "
            f"AND b.idx = (sy // a.block) * a.ncols + sx // a.block {'AND ' + on if on else ''} GROUP BY ALL",
        )
        return self.add(
            name,
            f"SELECT * EXCLUDE (px, fills), px AS px_before, CASE WHEN fills IS NULL THEN px ELSE list_transform(range(len(px)), lambda i: "
            f"coalesce(list_filter(fills, lambda f: f.p = i)[1].v, px[(i+1)::INT])::INT) END AS px FROM {name}_g LEFT JOIN {name}_v USING ({keys}, ch, idx)",
        )

    def refilled(self, src: str, name: str, ratio: str, block: int = 8, keys: str = "owner_id") -> "Sql":
        self.region(src, f"{name}_g", "'crop_refill'", ratio)
        self.add(f"{name}_f", f"SELECT *, {noise('seed', 'owner_id', 'ch', 'idx', block * block)} AS nz FROM {name}_g")
        self.add(
            f"{name}_u",
            f"SELECT {keys}, ch, y0, y1, x0, x1, r * block + p // block AS y, c * block + p % block AS x, v::BIGINT AS v, f::BIGINT AS f, t FROM "
            f"(SELECT *, unnest(range(block * block)) AS p, unnest(px) AS v, unnest(nz) AS f, unnest(truth_px) AS t FROM {name}_f)",
        )
        iny, inx = "(y >= y0 AND y < y1)", "(x >= x0 AND x < x1)"
        ny = "((y >= y0 - 5 AND y < y0) OR (y >= y1 AND y < y1 + 5))"
        nx = "((x >= x0 - 5 AND x < x0) OR (x >= x1 AND x < x1 + 5))"
        ring = f"(({ny} AND {inx}) OR ({nx} AND {iny}))"
        self.add(
            f"{name}_m",
            f"SELECT {keys}, ch, count_if({ring}) AS rn, coalesce(sum(v) FILTER (WHERE {ring}), 0)::BIGINT AS rs, coalesce(sum(v * v) FILTER (WHERE {ring}), 0)::BIGINT AS rq, "
            f"count(*) AS wn, sum(v)::BIGINT AS ws, sum(v * v)::BIGINT AS wq, count_if(t) AS pn, coalesce(sum(f) FILTER (WHERE t), 0)::BIGINT AS ps, "
            f"coalesce(sum(f * f) FILTER (WHERE t), 0)::BIGINT AS pq FROM {name}_u GROUP BY ALL",
        )
        pick = lambda s: f"(CASE WHEN rn > 0 THEN r{s} ELSE w{s} END)"
        self.add(
            f"{name}_k",
            f"SELECT {keys}, ch, {pick('s')} / {pick('n')} AS bm, sqrt(({pick('n')} * {pick('q')} - {pick('s')} * {pick('s')})::DOUBLE) / {pick('n')} AS bs, "
            f"ps / greatest(pn, 1) AS pm, sqrt((pn * pq - ps * ps)::DOUBLE) / greatest(pn, 1) AS pd FROM {name}_m",
        )
        value = "greatest(0, least(255, floor(round((nz[(i+1)::INT] - pm) / (CASE WHEN pd > 1e-6 THEN pd ELSE 1.0 END) * bs + bm, 6))))::INT"
        return self.add(
            name,
            f"SELECT * EXCLUDE (px, nz, bm, bs, pm, pd), px AS px_before, list_transform(range(len(px)), lambda i: CASE WHEN truth_px[(i+1)::INT] THEN {value} "
            f"ELSE px[(i+1)::INT] END) AS px FROM {name}_f JOIN {name}_k USING ({keys}, ch)",
        )

    def blobbed(self, src: str, name: str, ratio: str, keys: str = "owner_id", base: str = "20260811") -> "Sql":
        """Discs at pixel level, three rescale rounds, linear filling along pixel rows."""
        self.add(
            f"{name}_o0",
            f"SELECT {keys}, height, width, {seed(repr(base), 'stem', repr('inpaint_removal'), ratio)} AS seed, ({ratio})::DOUBLE AS share FROM {src} WHERE idx = 0 AND ch = 0",
        )
        discs = ", ".join(
            f"struct_pack(angle := {uniform('seed', f'angle{i}')} * 6.283185307179586, frac := {uniform('seed', f'frac{i}')} * 0.8)" for i in range(6)
        )
        self.add(
            f"{name}_o1",
            f"SELECT *, [{discs}][1:(floor({uniform('seed', 'discs')} * 4) + 3)::INT] AS circles, ({uniform('seed', 'cy')} * 0.5 + 0.25) * height AS cy, "
            f"({uniform('seed', 'cx')} * 0.5 + 0.25) * width AS cx FROM {name}_o0",
        )
        self.add(f"{name}_r0", f"SELECT *, sqrt(share * height * width / (len(circles) * pi())) AS radius FROM {name}_o1")
        placed = lambda t: (
            f"SELECT *, greatest(1, round_even(radius, 0)::BIGINT) AS ri, list_transform(circles, lambda d: struct_pack("
            f"y := round_even(cy + sin(d.angle) * d.frac * radius, 0)::BIGINT, x := round_even(cx + cos(d.angle) * d.frac * radius, 0)::BIGINT)) AS discs FROM {t}"
        )
        hit = "len(list_filter(discs, lambda d: (y - d.y) * (y - d.y) + (x - d.x) * (x - d.x) <= ri * ri)) > 0"
        for i in range(3):
            self.add(f"{name}_p{i}", placed(f"{name}_r{i}"))
            self.add(f"{name}_a{i}", f"SELECT {keys}, count_if({hit}) AS area FROM (SELECT *, unnest(range(width)) AS x FROM (SELECT *, unnest(range(height)) AS y FROM {name}_p{i})) GROUP BY ALL")
            self.add(
                f"{name}_r{i + 1}",
                f"SELECT p.* EXCLUDE (radius, ri, discs), radius * CASE WHEN area / (height * width) <= 1e-9 THEN 2.0 ELSE sqrt(share / (area / (height * width))) END AS radius "
                f"FROM {name}_p{i} p JOIN {name}_a{i} USING ({keys})",
            )
        self.add(f"{name}_d", placed(f"{name}_r3"))
        self.add(
            f"{name}_u",
            f"SELECT *, {hit} AS t FROM (SELECT {keys}, ch, idx, p, r * block + p // block AS y, c * block + p % block AS x, v FROM "
            f"(SELECT *, unnest(range(block * block)) AS p, unnest(px) AS v FROM {src})) JOIN (SELECT {keys}, discs, ri FROM {name}_d) USING ({keys})",
        )
        w = f"PARTITION BY {keys}, ch, y ORDER BY x ROWS BETWEEN"
        side = lambda fn, frame: f"{fn}(CASE WHEN NOT t THEN struct_pack(x := x, v := v) END IGNORE NULLS) OVER ({w} {frame})"
        self.add(
            f"{name}_w",
            f"SELECT *, {side('last_value', 'UNBOUNDED PRECEDING AND CURRENT ROW')} AS lf, {side('first_value', 'CURRENT ROW AND UNBOUNDED FOLLOWING')} AS rt FROM {name}_u",
        )
        fill = (
            "CASE WHEN NOT t THEN v WHEN lf IS NOT NULL AND rt IS NOT NULL THEN ((lf.v * (rt.x - x) + rt.v * (x - lf.x)) // (rt.x - lf.x))::INT "
            "WHEN lf IS NOT NULL THEN lf.v WHEN rt IS NOT NULL THEN rt.v ELSE 128 END"
        )
        self.add(f"{name}_g", f"SELECT {keys}, ch, idx, list({fill} ORDER BY p) AS filled, list(t ORDER BY p) AS truth_px FROM {name}_w GROUP BY ALL")
        return self.add(
            name,
            f"SELECT s.* EXCLUDE (px), px AS px_before, filled AS px, truth_px, o.seed FROM {src} s JOIN {name}_g USING ({keys}, ch, idx) "
            f"JOIN (SELECT {keys}, seed FROM {name}_d) o USING ({keys})",
        )

    def damage_summary(self, src: str, name: str, keys: str = "owner_id") -> "Sql":
        return self.add(
            name,
            f"SELECT {keys}, sum(n)::BIGINT AS n_px, sum(hit)::BIGINT AS n_region_px, sum(kept)::BIGINT AS n_coincidental_px FROM (SELECT {keys}, idx, count(DISTINCT p) AS n, "
            f"count(DISTINCT p) FILTER (WHERE t) AS hit, count(DISTINCT p) FILTER (WHERE t AND same) AS kept FROM (SELECT {keys}, idx, p, bool_or(t) AS t, bool_and(a = b) AS same FROM "
            f"(SELECT *, unnest(range(block * block)) AS p, unnest(truth_px) AS t, unnest(px) AS a, unnest(px_before) AS b FROM {src}) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL",
        )
