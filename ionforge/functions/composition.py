"""Formula algebra: formulas are parsed by an Arrow function in the tasks, no shuffle; the rest are Catalyst expressions.

A formula is read as a list of items (symbol or bracket, with an optional
count), from right to left: a stack holds the running multipliers, so a count
behind a bracket is known before the atoms it covers.  A task keeps the last
formulas that it parsed, so columns of a row that repeat one another, and
formulas that come again soon, are parsed once.
"""

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ionforge.constants import ATOMIC_NUMBER, ELEMENTS

# Limits of the accepted notation.
MAX_LENGTH = 1024
MAX_DEPTH = 12
MAX_ATOMS = 1_000_000_000
#: Formulas that a task remembers: more than the columns of an Arrow batch hold.
REMEMBERED = 1 << 15

ITEM = re.compile(r"[A-Z][a-z]?[0-9]*|[(\[]|[)\]][0-9]*")
PARTS = re.compile(r"([A-Z][a-z]?|[()\[\]])([0-9]*)")
EMPTY_GROUP = re.compile(r"[(\[][)\]]")
#: Counts are 1 to 1,000,000 without leading zeros.
SOUND = re.compile(r"(?:(?:[A-Z][a-z]?|[)\]])(?:1000000|[1-9][0-9]{0,5})?+|[(\[])*+")
OPENED = {"(": ")", "[": "]"}
KNOWN = frozenset(ELEMENTS)
COMPOSITION_TYPE = "array<struct<e:string,n:bigint>>"


def _total(comp):
    return f"aggregate({comp}, 0L, (t, a) -> t + a.n)"


def _atoms(text):
    """Atoms of a text in the accepted notation by element, and the first fault of its groups."""
    mult, closed, depth, atoms = [1], [], 0, {}
    for symbol, count in reversed(PARTS.findall(text)):
        if symbol in ")]":
            mult.append(mult[-1] * int(count or 1))
            closed.append(symbol)
            depth = max(depth, len(closed))
        elif symbol in "([":
            if not closed or closed.pop() != OPENED[symbol]:
                return atoms, "unbalanced_group"
            mult.pop()
        else:
            atoms[symbol] = atoms.get(symbol, 0) + mult[-1] * int(count or 1)
    return atoms, "unbalanced_group" if closed else "nesting_limit" if depth > MAX_DEPTH else None


@lru_cache(REMEMBERED)
def parse(text):
    """A formula's (element, count) pairs sorted by element, or None, and its error, or None."""
    if not text or len(text) > MAX_LENGTH:
        return None, "empty_or_oversized"
    sound = SOUND.fullmatch(text) is not None
    if not sound and ITEM.sub("", text):
        return None, "unsupported_notation"
    if EMPTY_GROUP.search(text):
        return None, "empty_group"
    if not sound:
        return None, "invalid_count"
    atoms, error = _atoms(text)
    if error is None and not KNOWN.issuperset(atoms):
        error = "unknown_element"
    if error is None and sum(atoms.values()) > MAX_ATOMS:
        error = "atom_limit"
    return (None, error) if error else (tuple(sorted(atoms.items())), None)


def _key(atoms):
    return "|".join([f"{e}:{n}" for e, n in atoms])


@lru_cache(REMEMBERED)
def algebra(text, ion):
    """Of a formula: key of the reduced composition, key of the reduced host, loading and fraction of an ion; None where undefined."""
    comp = parse(text)[0]
    if comp is None:
        return None, None, None, None
    divisor = math.gcd(*[n for _, n in comp])
    key = _key([(e, n // divisor) for e, n in comp])
    rest = [(e, n) for e, n in comp if e != ion]
    if not rest:
        return key, None, None, None
    divisor, total = math.gcd(*[n for _, n in rest]), sum(n for _, n in comp)
    own = total - sum(n for _, n in rest)
    return key, _key([(e, n // divisor) for e, n in rest]), own / divisor, own / total


def _parsed(formula: pa.Array) -> pa.Array:
    found = [parse(t) for t in formula.to_pylist()]
    offsets, symbols, counts = [0], [], []
    for comp, _ in found:
        for e, n in comp or ():
            symbols.append(e)
            counts.append(n)
        offsets.append(len(symbols))
    atoms = pa.StructArray.from_arrays([pa.array(symbols, pa.string()), pa.array(counts, pa.int64())], ["e", "n"])
    comps = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), atoms, mask=pa.array([c is None for c, _ in found], pa.bool_()))
    return pa.StructArray.from_arrays([comps, pa.array([e for _, e in found], pa.string())], ["comp", "error"])


#: Kinds of characters in the accepted notation.
OTHER, UPPER, LOWER, DIGIT, ROUND, SQUARE, ROUND_END, SQUARE_END = range(8)


def _kinds():
    kinds = np.zeros(256, np.uint8)
    for first, last, kind in (("A", "Z", UPPER), ("a", "z", LOWER), ("0", "9", DIGIT), ("(", "(", ROUND), ("[", "[", SQUARE), (")", ")", ROUND_END), ("]", "]", SQUARE_END)):
        kinds[ord(first) : ord(last) + 1] = kind
    return kinds


def _symbols():
    """Atomic number by first letter and second letter (0: none); 0 for an unknown symbol."""
    table = np.zeros((26, 27), np.int64)
    for e, z in ATOMIC_NUMBER.items():
        table[ord(e[0]) - 65, ord(e[1]) - 96 if len(e) > 1 else 0] = z
    return table


KIND, SYMBOL = _kinds(), _symbols()


def _plain_atoms(formula):
    """Atoms of the formulas of an array that are plainly in order, in one go: row, atomic number and count, and which rows they are.

    All others, faulty ones among them, are left to ``parse``.
    """
    size = len(formula)
    ends = np.frombuffer(formula.buffers()[1], np.int32)[formula.offset : formula.offset + size + 1]
    chars = np.frombuffer(formula.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    length = np.diff(ends)
    row, kind = np.repeat(np.arange(size), length), KIND[chars]
    before = np.concatenate([[OTHER], kind[:-1]])[: len(kind)]
    before[(ends[:-1] - ends[0])[length > 0]] = OTHER
    digit, lower, symbol = kind == DIGIT, kind == LOWER, before == UPPER
    first = digit & (before != DIGIT)
    odd = (kind == OTHER) | (lower & ~symbol) | (digit & ((before == OTHER) | (before == ROUND) | (before == SQUARE)))
    odd |= (kind >= ROUND_END) & ((before == ROUND) | (before == SQUARE))
    odd |= first & (chars == ord("0"))
    fine = (length > 0) & (length <= MAX_LENGTH)
    fine[row[odd]] = False
    # a token is a symbol or a bracket; the digits behind it are its count
    token = np.flatnonzero((kind == UPPER) | (kind >= ROUND))
    start, run = np.flatnonzero(first), np.cumsum(first) - 1
    place = np.flatnonzero(digit)
    digits = np.bincount(run[place], minlength=len(start)) if len(start) else np.empty(0, np.int64)
    fine[row[start[digits > 6]]] = False
    power = (start + digits - 1)[run[place]] - place
    value = np.bincount(run[place], (chars[place] - 48.0) * 10.0 ** np.minimum(power, 6), len(start)) if len(start) else np.empty(0)
    owner, small = np.searchsorted(token, start) - 1, np.flatnonzero(lower & symbol)
    count, second = np.ones(len(token)), np.zeros(len(token), np.int64)
    mine = (owner >= 0) & (row[token[owner]] == row[start]) if len(token) else owner >= 0  # digits before any token have none
    count[owner[mine]] = value[mine]
    second[np.searchsorted(token, small) - 1] = chars[small] - 96
    row, kind, letter = row[token], kind[token], chars[token].astype(np.int64) - 65
    change = np.where(kind >= ROUND_END, -1, np.where(kind >= ROUND, 1, 0))
    depth = np.cumsum(change)
    held = np.bincount(row, change, size)
    depth -= (np.cumsum(held) - held).astype(np.int64)[row]
    fine &= held == 0
    fine[row[(depth < 0) | (depth > MAX_DEPTH)]] = False
    atom = kind == UPPER
    z = np.where(atom, SYMBOL[np.where(atom, letter, 0), second], 0)
    fine[row[atom & (z == 0)]] = False
    own = fine[row]
    row, kind, count, depth, z, atom = row[own], kind[own], count[own], depth[own], z[own], atom[own]
    times, at = count.copy(), np.arange(len(row))
    for level in range(1, int(depth.max(initial=0)) + 1):
        # the brackets of one depth open and close by turns
        opened = np.flatnonzero((kind >= ROUND) & (kind < ROUND_END) & (depth == level))
        closed = np.flatnonzero((kind >= ROUND_END) & (depth == level - 1))
        fine[row[opened[kind[opened] + 2 != kind[closed]]]] = False
        inside = np.flatnonzero(atom & (depth >= level))
        times[inside] *= count[closed][np.searchsorted(opened, at[inside]) - 1]
    fine &= np.bincount(row[atom], times[atom], size) <= MAX_ATOMS
    own = atom & fine[row]
    return row[own], z[own], times[own].astype(np.int64), fine


def atoms_of(formula):
    """Atoms of an array of formulas by row and atomic number: row, number and count; a formula that doesn't parse has none (``parse``)."""
    row, z, n, fine = _plain_atoms(formula)
    others = np.flatnonzero(~fine)
    if len(others):
        found = [(r, ATOMIC_NUMBER[e], c) for r, text in zip(others.tolist(), formula.take(pa.array(others)).to_pylist()) for e, c in parse(text)[0] or ()]
        more = np.array(found, np.int64).reshape(-1, 3)
        row, z, n = (np.concatenate([a, more[:, i]]) for i, a in enumerate((row, z, n)))
    key = row * 128 + z
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    key, n = key[order][first], np.add.reduceat(n[order], first) if len(first) else n
    return key // 128, key % 128, n


class Endpoint:
    """Formulas of one side of reactions: atoms by row and atomic number, and the host without each row's ion.

    ``loading`` and ``fraction`` are NaN where no host remains.
    """

    def __init__(self, formula, ion):
        size = len(formula)
        self.row, self.z, self.n = atoms_of(formula)
        self.size = np.bincount(self.row, minlength=size)
        ions = ion.dictionary_encode()
        number = np.array([ATOMIC_NUMBER.get(e, -1) for e in ions.dictionary.to_pylist()] + [-1], np.int64)
        at = ions.indices.fill_null(len(number) - 1).to_numpy(zero_copy_only=False)
        host = self.z != number[at][self.row]
        row, n = self.row[host], self.n[host]
        self.left = np.bincount(row, minlength=size)
        starts = (np.cumsum(self.left) - self.left)[self.left > 0]
        divisor = np.ones(size, np.int64)
        if len(starts):
            divisor[self.left > 0] = np.gcd.reduceat(n, starts)
        self.rows, self.numbers, self.counts = row, self.z[host], n // divisor[row]
        total = np.bincount(self.row, self.n, size)
        own = np.where(self.left > 0, total - np.bincount(row, n, size), np.nan)
        with np.errstate(invalid="ignore"):
            self.loading, self.fraction = own / divisor, own / total

    def differs(self, other):
        """Rows whose reduced hosts aren't those of ``other``."""
        unlike = self.left != other.left
        mine, theirs = ~unlike[self.rows], ~unlike[other.rows]
        off = (self.numbers[mine] != other.numbers[theirs]) | (self.counts[mine] != other.counts[theirs])
        unlike[self.rows[mine][off]] = True
        return unlike


#: Place of an element, by atomic number, in the order of the symbols' text, and the symbols by place.
PLACE = np.zeros(128, np.int64)
PLACE[[ATOMIC_NUMBER[e] for e in sorted(ELEMENTS)]] = np.arange(len(ELEMENTS))
SYMBOLS = pa.array([f"{e}:" for e in sorted(ELEMENTS)])


def _keys(size, row, z, n):
    """Text of the atoms of every row, by element, as ``_key`` writes it; null without atoms."""
    order = np.argsort(row * 128 + PLACE[z])
    pairs = pc.binary_join_element_wise(SYMBOLS.take(pa.array(PLACE[z[order]])), pa.array(n[order]).cast(pa.string()), "")
    number = np.bincount(row, minlength=size)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32)), pairs, mask=pa.array(number == 0))
    return pc.binary_join(lists, "|")


def _algebra(formula: pa.Array, ion: pa.Array) -> pa.Array:
    """``algebra`` of a batch in one go; formulas that aren't plainly in order go to ``parse`` one by one."""
    own = Endpoint(pc.fill_null(formula, ""), ion)
    size, none = len(formula), own.left == 0
    divisor = np.ones(size, np.int64)
    if len(own.n):
        divisor[own.size > 0] = np.gcd.reduceat(own.n, (np.cumsum(own.size) - own.size)[own.size > 0])
    columns = [_keys(size, own.row, own.z, own.n // divisor[own.row]), _keys(size, own.rows, own.numbers, own.counts),
               pa.array(own.loading, mask=none), pa.array(own.fraction, mask=none)]
    return pa.StructArray.from_arrays(columns, ["key", "host", "loading", "fraction"])


def evaluated_once(df, *names):
    """Pass computed columns through a one-row generator.

    A filter on them is then applied to the value instead of being pushed
    below, where the optimizer would repeat the whole expression.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names))))


def parse_formulas(df, **columns):
    """Add one parsed struct ``<comp, error>`` per ``out=formula_column``."""
    of = F.arrow_udf(_parsed, f"struct<comp:{COMPOSITION_TYPE},error:string>")
    return evaluated_once(df.withColumns({out: of(F.col(f)) for out, f in columns.items()}), *columns)


def with_algebra(df, ion, **columns):
    """Add struct(key, host, loading, fraction) per ``out=formula_column``: keys of the reduced formula and host as text (``algebra``)."""
    of = F.arrow_udf(_algebra, "struct<key:string,host:string,loading:double,fraction:double>")
    return evaluated_once(df.withColumns({out: of(F.col(f), F.col(ion)) for out, f in columns.items()}), *columns)


def _gcd(comp):
    """Greatest common divisor of the counts (null for an empty composition)."""
    euclid = ("aggregate(sequence(1, 48), named_struct('x', g, 'y', n), (s, k) -> "
              "if(s.y = 0, s, named_struct('x', s.y, 'y', s.x % s.y)), s -> s.x)")
    counts = f"transform({comp}, a -> a.n)"
    low = f"array_min({counts})"
    return f"if({low} = 1, 1L, aggregate({counts}, {low}, (g, n) -> case when g = 1 or n % g = 0 then g else {euclid} end))"


def _divide(comp, divisor):
    return f"if({divisor} = 1, {comp}, transform({comp}, a -> named_struct('e', a.e, 'n', a.n div {divisor})))"


def composition_gcd(comp):
    return F.expr(_gcd(comp))


def atoms_in(comp):
    return F.expr(_total(comp))


def reduce_composition(df, **columns):
    """Add ``out``: composition column divided by the gcd of its counts, still sorted by element."""
    div = lambda o: f"__{o}_gcd"
    df = df.withColumns({div(o): F.expr(_gcd(c)) for o, c in columns.items()})
    return df.withColumns({o: F.expr(_divide(c, div(o))) for o, c in columns.items()}).drop(*[div(o) for o in columns])


def host_key(comp, pair=":", sep="|"):
    """Canonical text of a composition column (given by name)."""
    return F.expr(f"array_join(transform({comp}, a -> concat(a.e, '{pair}', a.n)), '{sep}')")


def with_host(df, ion, **columns):
    """Add ``out``: struct(host, divisor, ion_count, loading, fraction); null if no host remains."""
    rest, div = (lambda o: f"__{o}_rest"), (lambda o: f"__{o}_div")
    df = df.withColumns({rest(o): F.expr(f"filter({c}, a -> not (a.e <=> {ion}))") for o, c in columns.items()})
    df = df.withColumns({div(o): F.expr(_gcd(rest(o))) for o in columns})

    def struct(o, c):
        n_ion = f"({_total(c)} - {_total(rest(o))})"
        return f"""if(size({rest(o)}) > 0, named_struct('host', {_divide(rest(o), div(o))}, 'divisor', {div(o)},
            'ion_count', {n_ion}, 'loading', {n_ion} / cast({div(o)} as double), 'fraction', {n_ion} / cast({_total(c)} as double)), null)"""

    df = df.withColumns({o: F.expr(struct(o, c)) for o, c in columns.items()})
    return evaluated_once(df.drop(*[name(o) for o in columns for name in (rest, div)]), *columns)
