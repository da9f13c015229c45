"""One file of token ids: independent zstandard frames, a table of documents, a trailing seek table.

The layout is zstandard's public seekable format, so any zstandard reader can decompress the file as one stream of ids (unsigned little-endian, ``width``
bytes each). After the data frames comes a skippable frame with the documents (key, whether it has one, number of ids), then the skippable frame of
the seek table: for every frame its size in the file, its size when decompressed and a checksum of what it holds. Readers take the seek
table from the end of the file, know the frame of any id from it, and read and decompress that frame only.

Frames hold ``frame_ids`` ids whatever the documents; a long document runs over several, short ones share one. A file that is cut short, changed or of another kind raises
``DamagedFile``. A file without documents is a valid file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import xxhash
import zstandard

# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
_FOOTER = struct.Struct("<IBI")
_HEAD = struct.Struct("<II")
_ENTRY = np.dtype([("stored", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
_DOCUMENT = np.dtype([("key", "<i8"), ("has_key", "u1"), ("ids", "<i8")])
_INFO = struct.Struct("<BxxxI")


class DamagedFile(ValueError):
    """The file does not hold what its tables say."""


def checksum(data: bytes) -> int:
    """The low 32 bits of XXH64, as the seekable format has it."""
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    """Appends documents to an open binary stream; memory holds one frame and 17 bytes a document."""

    def __init__(self, out: BinaryIO, width: int = 2, frame_ids: int = 1 << 15, level: int = 3):
        if width not in (2, 4) or not 1 <= frame_ids * width < 1 << 31:
            raise ValueError("ids take 2 or 4 bytes, a frame below 2 GB")
        self.out, self.kind, self.frame_ids = out, np.dtype(f"<u{width}"), frame_ids
        self.packer = zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.keys: list[int | None] = []
        self.sizes: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def _put(self, ids: np.ndarray) -> None:
        raw = ids.astype(self.kind).tobytes()
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), checksum(raw)))

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > np.iinfo(self.kind).max:
            raise ValueError(f"an id does not fit into {self.kind.itemsize} bytes")
        self.keys.append(key)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.frame_ids:
            ids = np.concatenate(self.waiting)
            whole = len(ids) - len(ids) % self.frame_ids
            for low in range(0, whole, self.frame_ids):
                self._put(ids[low : low + self.frame_ids])
            self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        """Write what waits and the tables; the stream stays open."""
        if self.n_waiting:
            self._put(np.concatenate(self.waiting))
        docs = np.zeros(len(self.keys), _DOCUMENT)
        docs["key"] = [0 if k is None else k for k in self.keys]
        docs["has_key"] = [k is not None for k in self.keys]
        docs["ids"] = self.sizes
        body = _INFO.pack(self.kind.itemsize, self.frame_ids) + self.packer.compress(docs.tobytes())
        self.out.write(_HEAD.pack(SKIPPABLE, len(body)) + body)
        self.entries.append((_HEAD.size + len(body), 0, checksum(body)))
        table = np.array(self.entries, _ENTRY).tobytes()
        footer = _FOOTER.pack(len(self.entries), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(_HEAD.pack(SEEK_TABLE, len(table) + len(footer)) + table + footer)


class FrameReader:
    """Documents of one file; ``frames_read`` counts the frames that were decompressed."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.frames_read = stream, 0
        self.unpacker = zstandard.ZstdDecompressor()
        end = stream.seek(0, 2)
        n, flags, magic = _FOOTER.unpack(self._bytes(max(0, end - _FOOTER.size), _FOOTER.size))
        if magic != SEEKABLE or flags != WITH_CHECKSUMS:
            raise DamagedFile("no seek table at the end")
        size = n * _ENTRY.itemsize
        at = end - _FOOTER.size - size - _HEAD.size
        if n == 0 or at < 0 or _HEAD.unpack(self._bytes(at, _HEAD.size)) != (SEEK_TABLE, size + _FOOTER.size):
            raise DamagedFile("the seek table has another size")
        self.table = np.frombuffer(self._bytes(at + _HEAD.size, size), _ENTRY)
        self.place = np.r_[0, np.cumsum(self.table["stored"].astype(np.int64))]
        if self.place[-1] != at:
            raise DamagedFile("frames and seek table do not meet")
        body = self._bytes(int(self.place[-2]), int(self.table["stored"][-1]))[_HEAD.size :]
        if checksum(body) != self.table["checksum"][-1]:
            raise DamagedFile("the table of documents is damaged")
        width, self.frame_ids = _INFO.unpack(body[: _INFO.size])
        self.kind = np.dtype(f"<u{width}")
        self.documents = np.frombuffer(self.unpacker.decompress(body[_INFO.size :]) if len(body) > _INFO.size else b"", _DOCUMENT)
        self.starts = np.r_[0, np.cumsum(self.documents["ids"])]
        if self.starts[-1] * width != self.table["size"].astype(np.int64).sum():
            raise DamagedFile("frames hold another number of ids than documents")
        self._held: tuple[int, np.ndarray] = (-1, np.zeros(0, self.kind))

    def _bytes(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        out = self.stream.read(n)
        if len(out) != n:
            raise DamagedFile("the file ends early")
        return out

    def _frame(self, k: int) -> np.ndarray:
        if self._held[0] != k:
            size = int(self.table["size"][k])
            try:
                raw = self.unpacker.decompress(self._bytes(int(self.place[k]), int(self.table["stored"][k])), max_output_size=size)
            except zstandard.ZstdError as e:
                raise DamagedFile(f"frame {k}: {e}") from e
            if len(raw) != size or checksum(raw) != self.table["checksum"][k]:
                raise DamagedFile(f"frame {k} does not match its checksum")
            self._held = (k, np.frombuffer(raw, self.kind))
            self.frames_read += 1
        return self._held[1]

    def ids(self, document: int) -> np.ndarray:
        """Ids of the document at this place of the file; only its frames are read."""
        low, high = int(self.starts[document]), int(self.starts[document + 1])
        if low == high:
            return np.zeros(0, np.uint32)
        parts = []
        for k in range(low // self.frame_ids, (high - 1) // self.frame_ids + 1):
            base = k * self.frame_ids
            parts.append(self._frame(k)[max(0, low - base) : high - base])
        return np.concatenate(parts).astype("<u4")

    def key(self, document: int) -> int | None:
        row = self.documents[document]
        return int(row["key"]) if row["has_key"] else None

    def __len__(self) -> int:
        return len(self.documents)

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(key, ids before it in the file, ids)`` in order; every frame is read once."""
        for k in range(len(self)):
            yield self.key(k), int(self.starts[k]), self.ids(k)
