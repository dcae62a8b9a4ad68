"""Commits of a git repository as a Python data source, without a git program.

    spark.dataSource.register(GitSource); spark.read.format("git_commits").load(path)

All commits reachable from HEAD and the branches are read, from loose objects and packs. The files of
a commit are those whose blob differs from its first parent's tree.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "hash string, author string, email string, date timestamp, message string, body string, files array<string>"
_KINDS = {1: b"commit", 2: b"tree", 3: b"blob", 4: b"tag"}


class Repository:
    """Reads objects of one repository; packs are opened once."""

    def __init__(self, path: str) -> None:
        git = os.path.join(path, ".git")
        self.root = git if os.path.isdir(git) else path
        self.packs = []
        folder = os.path.join(self.root, "objects", "pack")
        if os.path.isdir(folder):
            for name in sorted(os.listdir(folder)):
                if name.endswith(".idx"):
                    self.packs.append((self._index(os.path.join(folder, name)), os.path.join(folder, name[:-4] + ".pack")))

    @staticmethod
    def _index(path: str) -> dict[bytes, int]:
        with open(path, "rb") as f:
            raw = f.read()
        if raw[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError(f"{path}: only version 2 pack indexes are read")
        n = struct.unpack(">I", raw[8 + 255 * 4 : 8 + 256 * 4])[0]
        names = 8 + 1024
        offsets = names + n * 24
        wide = offsets + n * 4
        out = {}
        for i in range(n):
            at = struct.unpack(">I", raw[offsets + i * 4 : offsets + i * 4 + 4])[0]
            if at & 0x80000000:
                k = wide + (at & 0x7FFFFFFF) * 8
                at = struct.unpack(">Q", raw[k : k + 8])[0]
            out[raw[names + i * 20 : names + i * 20 + 20]] = at
        return out

    def read(self, sha: str) -> tuple[bytes, bytes]:
        loose = os.path.join(self.root, "objects", sha[:2], sha[2:])
        if os.path.exists(loose):
            with open(loose, "rb") as f:
                raw = zlib.decompress(f.read())
            head, _, body = raw.partition(b"\0")
            return head.split(b" ")[0], body
        key = bytes.fromhex(sha)
        for index, pack in self.packs:
            if key in index:
                return self._packed(index, pack, index[key])
        raise KeyError(sha)

    def _packed(self, index: dict[bytes, int], pack: str, at: int) -> tuple[bytes, bytes]:
        with open(pack, "rb") as f:
            f.seek(at)
            byte = f.read(1)[0]
            kind = (byte >> 4) & 7
            while byte & 0x80:
                byte = f.read(1)[0]
            base: tuple[bytes, bytes] | None = None
            if kind == 6:
                byte = f.read(1)[0]
                back = byte & 0x7F
                while byte & 0x80:
                    byte = f.read(1)[0]
                    back = ((back + 1) << 7) | (byte & 0x7F)
                where = f.tell()
                base = self._packed(index, pack, at - back)
                f.seek(where)
            elif kind == 7:
                base = self.read(f.read(20).hex())
            stream = zlib.decompressobj()
            out = b""
            while not stream.eof:
                chunk = f.read(65536)
                if not chunk:
                    break
                out += stream.decompress(chunk)
        if base is None:
            return _KINDS[kind], out
        return base[0], self._delta(base[1], out)

    @staticmethod
    def _delta(base: bytes, delta: bytes) -> bytes:
        at = 0

        def size() -> int:
            nonlocal at
            n = shift = 0
            while True:
                byte = delta[at]
                at += 1
                n |= (byte & 0x7F) << shift
                shift += 7
                if not byte & 0x80:
                    return n

        size()
        size()
        out = bytearray()
        while at < len(delta):
            op = delta[at]
            at += 1
            if op & 0x80:
                offset = length = 0
                for k in range(4):
                    if op & (1 << k):
                        offset |= delta[at] << (8 * k)
                        at += 1
                for k in range(3):
                    if op & (16 << k):
                        length |= delta[at] << (8 * k)
                        at += 1
                out += base[offset : offset + (length or 0x10000)]
            else:
                out += delta[at : at + op]
                at += op
        return bytes(out)

    def heads(self) -> list[str]:
        out = []
        packed = os.path.join(self.root, "packed-refs")
        if os.path.exists(packed):
            with open(packed) as f:
                out += [line.split()[0] for line in f if re.match(r"[0-9a-f]{40} refs/(heads|remotes)/", line)]
        for base, _, names in os.walk(os.path.join(self.root, "refs", "heads")):
            for n in names:
                with open(os.path.join(base, n)) as f:
                    out.append(f.read().strip())
        with open(os.path.join(self.root, "HEAD")) as f:
            head = f.read().strip()
        if re.fullmatch(r"[0-9a-f]{40}", head):
            out.append(head)
        return [h for h in dict.fromkeys(out) if re.fullmatch(r"[0-9a-f]{40}", h)]

    def commit(self, sha: str) -> dict:
        _, raw = self.read(sha)
        head, _, text = raw.decode("utf-8", "replace").partition("\n\n")
        out: dict = {"hash": sha, "parents": [], "tree": None, "author": None, "email": None, "date": None}
        for line in head.split("\n"):
            key, _, value = line.partition(" ")
            if key == "parent":
                out["parents"].append(value)
            elif key == "tree":
                out["tree"] = value
            elif key == "author" and (m := re.match(r"(.*?) <(.*?)> (\d+)", value)):
                out["author"], out["email"], out["date"] = m.group(1), m.group(2), int(m.group(3))
        message, _, body = text.strip().partition("\n")
        return out | {"message": message, "body": body.strip()}

    def entries(self, tree: str) -> dict[str, tuple[bool, str]]:
        _, raw = self.read(tree)
        out, at = {}, 0
        while at < len(raw):
            space, zero = raw.index(b" ", at), raw.index(b"\0", at)
            name = raw[space + 1 : zero].decode("utf-8", "replace")
            out[name] = (raw[at:space] == b"40000", raw[zero + 1 : zero + 21].hex())
            at = zero + 21
        return out

    def changed(self, tree: str | None, other: str | None, prefix: str = "") -> list[str]:
        """Paths whose blob differs between two trees; equal subtrees are not entered."""
        if tree == other:
            return []
        a = self.entries(tree) if tree else {}
        b = self.entries(other) if other else {}
        out = []
        for name in sorted(a.keys() | b.keys()):
            x, y = a.get(name), b.get(name)
            if x == y:
                continue
            folders = [e[1] if e and e[0] else None for e in (x, y)]
            if any(folders):
                out += self.changed(*folders, f"{prefix}{name}/")
            if (x and not x[0]) or (y and not y[0]):
                out.append(prefix + name)
        return out

    def walk(self, limit: int | None = None) -> Iterator[str]:
        seen, queue = set(), self.heads()
        while queue and (limit is None or len(seen) < limit):
            sha = queue.pop(0)
            if sha in seen:
                continue
            seen.add(sha)
            yield sha
            queue += self.commit(sha)["parents"]


class _Slice(InputPartition):
    def __init__(self, hashes: list[str]) -> None:
        super().__init__(hashes)
        self.hashes = hashes


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.limit = int(options["limit"]) if "limit" in options else None
        self.per = int(options.get("commits_per_partition", 1000))

    def partitions(self) -> list[_Slice]:
        hashes = list(Repository(self.path).walk(self.limit))
        return [_Slice(hashes[i : i + self.per]) for i in range(0, len(hashes), self.per)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        from datetime import datetime, timezone

        repo = Repository(self.path)
        for sha in partition.hashes:
            c = repo.commit(sha)
            parent = repo.commit(c["parents"][0])["tree"] if c["parents"] else None
            when = datetime.fromtimestamp(c["date"], timezone.utc) if c["date"] is not None else None
            yield c["hash"], c["author"], c["email"], when, c["message"], c["body"], repo.changed(c["tree"], parent)


class GitSource(DataSource):
    """Format ``git_commits``; options path, limit, commits_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
