"""Adaptive radix trees over byte strings.

A node's children stand under one byte each, in one of four layouts by their number: up to 4 or
up to 16 sorted bytes beside their children, an index of 256 places over up to 48 children, or 256
children. A node that is full takes the next layout. Runs of bytes without a branch stay with the node below them.
A key may be the beginning of another one.
"""

from __future__ import annotations

from bisect import bisect_left

SIZES = (4, 16, 48, 256)


def shared(a: bytes, b: bytes) -> int:
    """Bytes that two strings begin with alike."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class Node:
    """``prefix`` are the bytes after the one that leads here; ``value`` belongs to the key that ends here."""

    __slots__ = ("kids", "marks", "prefix", "size", "value")

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value = prefix, value
        self.size, self.marks, self.kids = 0, None, None  # no place for children yet

    def find(self, byte: int):
        if self.size <= 16:
            i = self.marks.find(byte) if self.size else -1
            return self.kids[i] if i >= 0 else None
        if self.size == 48:
            i = self.marks[byte]
            return self.kids[i - 1] if i else None
        return self.kids[byte]

    def replace(self, byte: int, kid: Node) -> None:
        if self.size <= 16:
            self.kids[self.marks.find(byte)] = kid
        elif self.size == 48:
            self.kids[self.marks[byte] - 1] = kid
        else:
            self.kids[byte] = kid

    def add(self, byte: int, kid: Node) -> None:
        """A child under a byte that has none."""
        if self.size < 256 and (not self.size or len(self.kids) == self.size):
            self.grow()
        if self.size <= 16:
            i = bisect_left(self.marks, byte)
            self.marks.insert(i, byte)
            self.kids.insert(i, kid)
        elif self.size == 48:
            self.kids.append(kid)
            self.marks[byte] = len(self.kids)
        else:
            self.kids[byte] = kid

    def grow(self) -> None:
        """The next larger layout."""
        before = list(self.items())
        self.size = next(s for s in SIZES if s > self.size)
        if self.size <= 16:
            self.marks, self.kids = bytearray(b for b, _ in before), [k for _, k in before]
        elif self.size == 48:
            self.marks, self.kids = bytearray(256), [k for _, k in before]
            for i, (b, _) in enumerate(before):
                self.marks[b] = i + 1
        else:
            self.marks, self.kids = None, [None] * 256
            for b, k in before:
                self.kids[b] = k

    def items(self):
        """(byte, child) in order of the bytes."""
        if not self.size:
            return
        if self.size <= 16:
            yield from zip(self.marks, self.kids, strict=True)
        elif self.size == 48:
            yield from ((b, self.kids[i - 1]) for b, i in enumerate(self.marks) if i)
        else:
            yield from ((b, k) for b, k in enumerate(self.kids) if k is not None)


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        """Sets the value (not None) of a key."""
        node, above, by, at = self.root, None, 0, 0
        while True:
            if not key.startswith(node.prefix, at):
                n = shared(node.prefix, key[at : at + len(node.prefix)])
                fork = Node(node.prefix[:n])
                fork.add(node.prefix[n], node)
                node.prefix = node.prefix[n + 1 :]
                above.replace(by, fork)
                node = fork
            at += len(node.prefix)
            if at == len(key):
                node.value = value
                return
            kid = node.find(key[at])
            if kid is None:
                node.add(key[at], Node(key[at + 1 :], value))
                return
            node, above, by, at = kid, node, key[at], at + 1

    def get(self, key: bytes):
        node, at = self.root, 0
        while node is not None and key.startswith(node.prefix, at):
            at += len(node.prefix)
            if at == len(key):
                return node.value
            node, at = node.find(key[at]), at + 1
        return None

    def walk(self):
        """(node, position of the node above in this order, depth in bytes above, depth in bytes here), parents before their children."""
        stack, i = [(self.root, -1, 0, len(self.root.prefix))], 0
        while stack:
            node, above, start, end = stack.pop()
            yield node, above, start, end
            stack += [(kid, i, end, end + 1 + len(kid.prefix)) for _, kid in node.items()]
            i += 1
