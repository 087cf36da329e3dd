"""Reading and writing FITS binary tables with NumPy alone, as far as optical interferometry files need it."""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np

BLOCK, CARD = 2880, 80
# FITS column codes and their big-endian types.
TYPES = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "A": "S", "E": ">f4", "D": ">f8"}


@dataclass
class Table:
    """One binary table: its name, header keywords and columns, each an array with a row a line."""

    name: str
    header: dict = field(default_factory=dict)
    columns: dict[str, np.ndarray] = field(default_factory=dict)


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        end = text.find("'", 1)
        while text[end : end + 2] == "''":
            end = text.find("'", end + 2)
        return text[1:end].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        return float(text.replace("D", "E")) if text else None


def _header(data: bytes, at: int) -> tuple[dict, int]:
    out: dict = {}
    while True:
        block = data[at : at + BLOCK]
        if len(block) < BLOCK:
            raise ValueError("the file ends inside a header")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD].decode("latin-1")
            key = card[:8].strip()
            if key == "END":
                return out, at
            if card[8:10] == "= ":
                out[key] = _value(card[10:])


def _field(form: str) -> tuple[int, str]:
    digits = "".join(c for c in form if c.isdigit())
    code = next(c for c in form if c.isalpha())
    if code not in TYPES:
        raise ValueError(f"column form {form} is not supported")
    return int(digits or 1), code


@dataclass
class Part:
    """Where a binary table lies in a file."""

    header: dict
    at: int

    @property
    def name(self) -> str:
        return str(self.header.get("EXTNAME", "")).strip()

    @property
    def rows(self) -> int:
        return self.header["NAXIS2"]


def parts(f) -> list[Part]:
    """The binary tables of an open file, of which only the headers are read."""
    out, at, size = [], 0, f.seek(0, 2)
    while at < size:
        blocks = []
        while not blocks or not any(blocks[-1][i : i + 8].rstrip() == b"END" for i in range(0, BLOCK, CARD)):
            f.seek(at + len(blocks) * BLOCK)
            blocks.append(f.read(BLOCK))
            if len(blocks[-1]) < BLOCK:
                raise ValueError("the file ends inside a header")
        h, end = _header(b"".join(blocks), 0)
        at += end
        shape = [h[f"NAXIS{i}"] for i in range(1, h.get("NAXIS", 0) + 1)]
        long = (abs(h.get("BITPIX", 8)) // 8 * int(np.prod(shape)) if shape else 0) + h.get("PCOUNT", 0)
        if h.get("XTENSION", "").strip() == "BINTABLE":
            out.append(Part(h, at))
        at += -(-long // BLOCK) * BLOCK
    return out


def rows_of(f, part: Part, first: int = 0, last: int | None = None) -> Table:
    """Rows `first` to `last`, which is left out, of a table of an open file, scaled by TSCAL and TZERO."""
    h, kinds = part.header, []
    for i in range(1, h["TFIELDS"] + 1):
        n, code = _field(h[f"TFORM{i}"])
        kinds.append((h.get(f"TTYPE{i}", f"C{i}"), f"S{max(n, 1)}" if code == "A" else TYPES[code], () if code == "A" or n == 1 else (n,)))
    kind = np.dtype(kinds)
    last = part.rows if last is None else min(last, part.rows)
    f.seek(part.at + first * kind.itemsize)
    held = np.frombuffer(f.read((last - first) * kind.itemsize), kind, last - first)
    t = Table(part.name, h)
    for i, (name, _, _) in enumerate(kinds, 1):
        x, (_, code) = held[name], _field(h[f"TFORM{i}"])
        if code == "A":
            x = np.array([v.decode("latin-1").rstrip() for v in x], object)
        elif code == "L":
            x = x == b"T"
        else:
            x = x.astype(x.dtype.newbyteorder("="))
            if (s := h.get(f"TSCAL{i}", 1)) != 1 or (z := h.get(f"TZERO{i}", 0)) != 0:
                x = x * s + h.get(f"TZERO{i}", 0)
        t.columns[name] = x
    return t


def read(data: bytes) -> list[Table]:
    """All binary tables of a file."""
    f = io.BytesIO(data)
    return [rows_of(f, p) for p in parts(f)]


def _cards(items: dict) -> bytes:
    out = []
    for key, v in items.items():
        text = ("T" if v else "F").rjust(20) if isinstance(v, bool) else f"'{str(v).replace(chr(39), chr(39) * 2):<8}'" if isinstance(v, str) else (repr(v).upper() if isinstance(v, float) else str(v)).rjust(20)
        out.append(f"{key:<8}= {text}"[:CARD].ljust(CARD))
    text = "".join(out) + "END".ljust(CARD)
    return text.encode("latin-1").ljust(-(-len(text) // BLOCK) * BLOCK)


CODES = {"b": "L", "i2": "I", "i4": "J", "i8": "K", "f4": "E", "f8": "D"}


def _packed(columns: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The forms of columns, and their rows as they lie in a file."""
    kinds, forms, data = [], [], []
    for name, x in columns.items():
        x = np.asarray(x)
        if x.dtype.kind in "OSU":
            raw = [str(v).encode("latin-1") for v in x]
            n = max([1, *map(len, raw)])
            kinds.append((name, f"S{n}")), forms.append(f"{n}A"), data.append(raw)
            continue
        code = CODES["b" if x.dtype.kind == "b" else x.dtype.str[1:]]
        n = int(np.prod(x.shape[1:])) if x.ndim > 1 else 1
        kinds.append((name, TYPES[code], (n,) if x.ndim > 1 else ()))
        forms.append(f"{n}{code}")
        data.append(np.where(x, b"T", b"F") if code == "L" else x.reshape(len(x), -1) if x.ndim > 1 else x)
    rows = np.zeros(len(data[0]) if data else 0, np.dtype(kinds))
    for (name, *_), x in zip(kinds, data):
        rows[name] = x
    return forms, rows


def primary() -> bytes:
    """The empty primary part of a file."""
    return _cards({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0, "EXTEND": True})


def padding(size: int) -> bytes:
    return b"\0" * (-size % BLOCK)


def start(t: Table, n: int) -> bytes:
    """The header of a table of n rows, whose columns may hold any part of them; rows() of all parts and padding() follow."""
    forms, rows = _packed(t.columns)
    h = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": rows.dtype.itemsize, "NAXIS2": n, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(forms)}
    for i, (name, form) in enumerate(zip(t.columns, forms), 1):
        h |= {f"TTYPE{i}": name, f"TFORM{i}": form}
    h |= {"EXTNAME": t.name} | {k: v for k, v in t.header.items() if k not in h and not k.startswith(("TTYPE", "TFORM", "TSCAL", "TZERO", "NAXIS", "EXTNAME"))}
    return _cards(h)


def rows(t: Table) -> bytes:
    return _packed(t.columns)[1].tobytes()


def write(tables: list[Table]) -> bytes:
    """A file with an empty primary part and the given tables."""
    out = [primary()]
    for t in tables:
        body = rows(t)
        out += [start(t, len(_packed(t.columns)[1])), body, padding(len(body))]
    return b"".join(out)
