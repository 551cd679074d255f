"""Mesh files in memory: MEDIT (text, binary) and legacy VTK (text, binary), both ways."""

from __future__ import annotations

import io
import re
import struct
from dataclasses import dataclass, field

import numpy as np

from ..model import FormatError, UnsupportedVersion

NODE_COUNT = {"vertex": 1, "edge": 2, "triangle": 3, "quadrangle": 4, "quadrilateral": 4, "tetrahedron": 4, "hexahedron": 8}
_TITLE = {"vertex": "Vertices", "edge": "Edges", "triangle": "Triangles", "quadrangle": "Quadrangles", "quadrilateral": "Quadrilaterals", "tetrahedron": "Tetrahedra", "hexahedron": "Hexahedra"}
_SECTION = {v.lower(): k for k, v in _TITLE.items() if k != "vertex"} | {"quads": "quadrilateral"}
_CODE = {"edge": 5, "triangle": 6, "quadrangle": 7, "quadrilateral": 7, "tetrahedron": 8, "hexahedron": 10}
_OF_CODE = {5: "edge", 6: "triangle", 7: "quadrilateral", 8: "tetrahedron", 10: "hexahedron"}
_DIMENSION, _VERTICES, _END = 3, 4, 54
_VTK = {"vertex": 1, "edge": 3, "triangle": 5, "quadrangle": 9, "quadrilateral": 9, "tetrahedron": 10, "hexahedron": 12}
_OF_VTK = {1: "vertex", 3: "edge", 5: "triangle", 9: "quadrilateral", 10: "tetrahedron", 12: "hexahedron"}
_SKIPPED = {"corners": 1, "ridges": 1, "requiredvertices": 1, "requirededges": 1}


@dataclass
class Mesh:
    """Nodes (n x dimension, refs) and blocks of elements (type, elements x nodes, refs)."""

    dimension: int
    coords: np.ndarray
    refs: np.ndarray
    blocks: list[tuple[str, np.ndarray, np.ndarray]] = field(default_factory=list)


def sniff(head: bytes) -> str:
    """``medit-binary``, ``medit``, ``vtk``; FormatError for anything else."""
    if head[:4] in (b"\1\0\0\0", b"\0\0\0\1"):
        return "medit-binary"
    text = head.lstrip()
    if text[:20].lower() == b"meshversionformatted":
        return "medit"
    if text.startswith(b"# vtk DataFile"):
        return "vtk"
    raise FormatError("not a mesh file of a known format")


def parse(data: bytes) -> Mesh:
    kind = sniff(data[:256])
    return {"medit-binary": parse_medit_binary, "medit": lambda d: parse_medit(d.decode("utf-8", "replace")), "vtk": parse_vtk}[kind](data)


def parse_medit(text: str) -> Mesh:
    """Keywords in any case; refs that are missing count as 0; ids from 1 become ids from 0."""
    lines = [line.split("#")[0] for line in text.splitlines()]
    words = " ".join(lines).split()
    at = 0

    def take() -> str:
        nonlocal at
        if at >= len(words):
            raise FormatError("the file ends early")
        at += 1
        return words[at - 1]

    if take().lower() != "meshversionformatted":
        raise FormatError("MeshVersionFormatted is missing")
    take()
    if take().lower() != "dimension":
        raise FormatError("Dimension is missing")
    d = int(take())
    mesh = Mesh(d, np.zeros((0, d)), np.zeros(0, np.int64))
    number = re.compile(r"[-+.\d]")

    def table(columns: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal at
        n = int(take())
        end = at
        while end < len(words) and end - at < n * (columns + 1) and number.match(words[end]):
            end += 1
        got = end - at
        if got < n * columns:
            raise FormatError("a section ends early")
        wide = columns + 1 if got >= n * (columns + 1) else columns
        rows = np.array(words[at : at + n * wide], float).reshape(n, wide)
        at += n * wide
        return rows[:, :columns], rows[:, columns].astype(np.int64) if wide > columns else np.zeros(n, np.int64)

    while at < len(words):
        key = take().lower()
        if key == "end":
            break
        if key == "vertices":
            mesh.coords, mesh.refs = table(d)
        elif key in _SECTION:
            kind = _SECTION[key]
            nodes, refs = table(NODE_COUNT[kind])
            mesh.blocks.append((kind, nodes.astype(np.int64) - 1, refs))
        elif key in _SKIPPED:
            skipped = int(take())
            at += skipped
        else:
            raise FormatError(f"unknown section {key!r}")
    return mesh


@dataclass(frozen=True)
class Section:
    """Where the rows of a binary file's section are, and what they are like."""

    code: int
    is_nodes: bool
    kind: str
    start: int
    count: int
    row: np.dtype


def sections(f) -> tuple[int, list[Section]]:
    """Dimension and sections of a binary MEDIT file that can be read at any place: versions 1 to 4, either
    byte order; ends at the end code or the end of the file."""
    order = "<" if f.read(4) == b"\1\0\0\0" else ">"

    def take(kind: str) -> int:
        dtype = np.dtype(order + kind)
        raw = f.read(dtype.itemsize)
        if len(raw) < dtype.itemsize:
            raise FormatError("the file ends early")
        return int(np.frombuffer(raw, dtype)[0])

    version = take("i4")
    if version not in (1, 2, 3, 4):
        raise UnsupportedVersion(f"version {version}")
    integer = "i8" if version == 4 else "i4"
    real = "f4" if version == 1 else "f8"
    place = "i8" if version >= 3 else "i4"
    if take("i4") != _DIMENSION:
        raise FormatError("the dimension is missing")
    take(place)
    d = take("i4")
    end = f.seek(0, 2)
    at = 16 + np.dtype(place).itemsize
    out = []
    while at + 4 <= end:
        f.seek(at)
        code = take("i4")
        if code == _END:
            break
        take(place)
        n = take(integer)
        if code == _VERTICES:
            row, kind = np.dtype([("x", order + real, (d,)), ("r", order + integer)]), ""
        elif code in _OF_CODE:
            kind = _OF_CODE[code]
            row = np.dtype([("x", order + integer, (NODE_COUNT[kind],)), ("r", order + integer)])
        else:
            raise FormatError(f"unknown code {code}")
        at = f.tell()
        if at + n * row.itemsize > end:
            raise FormatError("the file ends early")
        out.append(Section(code, code == _VERTICES, kind, at, n, row))
        at += n * row.itemsize
    return d, out


def parse_medit_binary(data: bytes) -> Mesh:
    """A binary file that is in memory."""
    d, found = sections(io.BytesIO(data))
    mesh = Mesh(d, np.zeros((0, d)), np.zeros(0, np.int64))
    for s in found:
        rows = np.frombuffer(data, s.row, s.count, s.start)
        if s.is_nodes:
            mesh.coords, mesh.refs = rows["x"].astype(float), rows["r"].astype(np.int64)
        else:
            mesh.blocks.append((s.kind, rows["x"].astype(np.int64) - 1, rows["r"].astype(np.int64)))
    return mesh


def parse_vtk(data: bytes) -> Mesh:
    """Unstructured grids, text or binary (big-endian). Dimension 3; refs are 1 unless the file
    has ``node_refs`` and ``cell_refs``."""
    data = data.lstrip()
    at = 0

    def line() -> str:
        nonlocal at
        while True:
            end = data.find(b"\n", at)
            end = len(data) if end < 0 else end
            text = data[at:end].decode("latin-1").strip()
            at = end + 1
            if text or at >= len(data):
                return text

    if not line().startswith("# vtk DataFile"):
        raise FormatError("not a VTK file")
    head_end = data.find(b"\n", at)
    at = head_end + 1  # the title may be empty
    binary = line().upper() == "BINARY"
    kinds = {"float": ">f4", "double": ">f8", "int": ">i4", "unsigned_int": ">u4", "long": ">i8", "vtktypeint64": ">i8", "unsigned_long": ">u8", "short": ">i2", "unsigned_char": ">u1", "char": ">i1"}

    def numbers(n: int, kind: str) -> np.ndarray:
        nonlocal at
        if binary:
            t = np.dtype(kinds[kind.lower()])
            out = np.frombuffer(data, t, n, at)
            at += n * t.itemsize
            return out
        found: list[bytes] = []
        while len(found) < n:
            if at >= len(data):
                raise FormatError("the file ends early")
            end = data.find(b"\n", at)
            end = len(data) if end < 0 else end
            found += data[at:end].split()
            at = end + 1
        return np.array(found[:n], float)

    points, cells, types = np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    refs: dict[str, np.ndarray] = {}
    where, count = "", 0
    while at < len(data):
        words = line().split()
        if not words:
            break
        key = words[0].upper()
        if key == "DATASET" and words[1].upper() != "UNSTRUCTURED_GRID":
            raise FormatError(f"{words[1]} data sets are not read")
        if key == "POINTS":
            points = numbers(3 * int(words[1]), words[2]).astype(float).reshape(-1, 3)
        elif key == "CELLS":
            cells = numbers(int(words[2]), "int").astype(np.int64)
        elif key == "CELL_TYPES":
            types = numbers(int(words[1]), "int").astype(np.int64)
        elif key in ("POINT_DATA", "CELL_DATA"):
            where, count = key, int(words[1])
        elif key == "SCALARS":
            mark = at
            if line().split()[0].upper() != "LOOKUP_TABLE":
                at = mark
            refs[words[1]] = numbers(count * (int(words[3]) if len(words) > 3 else 1), words[2]).astype(np.int64)
        elif key == "FIELD":
            for _ in range(int(words[2])):
                name, width, n, kind = line().split()
                refs[name] = numbers(int(width) * int(n), kind).astype(np.int64)
    del where
    mesh = Mesh(3, points, refs.get("node_refs", np.ones(len(points), np.int64)))
    blocks: dict[str, tuple[list, list]] = {}
    i = 0
    cell_refs = refs.get("cell_refs", np.ones(len(types), np.int64))
    for k, t in enumerate(types):
        n = int(cells[i])
        if int(t) not in _OF_VTK:
            raise FormatError(f"cell type {t} is not known")
        nodes, r = blocks.setdefault(_OF_VTK[int(t)], ([], []))
        nodes.append(cells[i + 1 : i + 1 + n])
        r.append(cell_refs[k])
        i += n + 1
    mesh.blocks = [(kind, np.array(n, np.int64), np.array(r, np.int64)) for kind, (n, r) in blocks.items()]
    return mesh


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e16 else repr(float(x))


def to_medit(mesh: Mesh) -> bytes:
    out = [f"MeshVersionFormatted 2\nDimension {mesh.dimension}\n\nVertices\n\t{len(mesh.refs)}\n"]
    out += [f" {' '.join(map(_number, c))} {r}\n" for c, r in zip(mesh.coords.tolist(), mesh.refs.tolist())]
    for kind, nodes, refs in mesh.blocks:
        if kind == "vertex":
            continue
        out.append(f"\n{_TITLE[kind]}\n\t{len(refs)}\n")
        out += [f" {' '.join(str(v + 1) for v in n)} {r}\n" for n, r in zip(nodes.tolist(), refs.tolist())]
    return ("".join(out) + "\nEnd").encode()


def to_medit_binary(mesh: Mesh) -> bytes:
    at = 24
    out = [struct.pack("<iiiqi", 1, 4, _DIMENSION, at, mesh.dimension)]
    sections = [(_VERTICES, mesh.coords, mesh.refs, "<f8")] + [(_CODE[k], n + 1, r, "<i8") for k, n, r in mesh.blocks if k != "vertex"]
    for code, values, refs, kind in sections:
        width = values.shape[1] if len(values) else 0
        at += 20 + 8 * len(refs) * (width + 1)
        rows = np.zeros(len(refs), [("x", kind, (width,)), ("r", "<i8")])
        rows["x"], rows["r"] = values if len(values) else rows["x"], refs
        out += [struct.pack("<iqq", code, at, len(refs)), rows.tobytes()]
    return b"".join(out) + struct.pack("<i", _END)


def to_vtk(mesh: Mesh, binary: bool) -> bytes:
    if mesh.dimension > 3 or len(mesh.coords) >= 2**32:
        raise FormatError("VTK files hold three dimensions and 2**32 nodes at most")
    points = np.zeros((len(mesh.coords), 3))
    points[:, : mesh.dimension] = mesh.coords
    n = sum(len(r) for _, _, r in mesh.blocks)
    cells = np.concatenate([np.concatenate([np.full((len(v), 1), v.shape[1], np.int64), v], axis=1).ravel() for _, v, _ in mesh.blocks if len(v)] or [np.zeros(0, np.int64)])
    types = np.concatenate([np.full(len(r), _VTK[k], np.int64) for k, _, r in mesh.blocks] or [np.zeros(0, np.int64)])
    refs = np.concatenate([r for _, _, r in mesh.blocks] or [np.zeros(0, np.int64)])
    put = (lambda a, t: a.astype(t).tobytes() + b"\n") if binary else (lambda a, t: (" ".join(map(_number, a.ravel().tolist())) + "\n").encode())
    head = f"# vtk DataFile Version 2.0\n\n{'BINARY' if binary else 'ASCII'}\nDATASET UNSTRUCTURED_GRID\n"
    return b"".join([
        f"{head}POINTS {len(points)} double\n".encode(), put(points, ">f8"),
        f"\nCELLS {n} {len(cells)}\n".encode(), put(cells, ">i4"),
        f"\nCELL_TYPES {n}\n".encode(), put(types, ">i4"),
        f"\nPOINT_DATA {len(points)}\nSCALARS node_refs vtktypeint64 1\nLOOKUP_TABLE default\n".encode(), put(mesh.refs, ">i8"),
        f"\nCELL_DATA {n}\nSCALARS cell_refs vtktypeint64 1\nLOOKUP_TABLE default\n".encode(), put(refs, ">i8"),
    ])
