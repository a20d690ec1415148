"""Bit strings that grow at the end or are read from the front, in either bit order."""

from __future__ import annotations


class BitSink:
    """Collects bits; ``lsb`` puts the first bit of a byte lowest."""

    def __init__(self, lsb: bool = False):
        self.lsb, self.value, self.n, self.done = lsb, 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        """The lowest ``n`` bits of a value."""
        value &= (1 << n) - 1
        if self.lsb:
            self.value |= value << self.n
            self.n += n
            while self.n >= 8:
                self.done.append(self.value & 255)
                self.value >>= 8
                self.n -= 8
        else:
            self.value = self.value << n | value
            self.n += n
            while self.n >= 8:
                self.n -= 8
                self.done.append(self.value >> self.n & 255)
            self.value &= (1 << self.n) - 1

    def ones(self, n: int) -> None:
        while n > 0:
            self.put((1 << min(n, 32)) - 1, min(n, 32))
            n -= 32

    def bytes(self) -> bytes:
        """All bits, the last byte filled up with zeros."""
        if not self.n:
            return bytes(self.done)
        return bytes(self.done) + bytes([self.value if self.lsb else self.value << (8 - self.n)])


class BitTap:
    """Reads bits of a byte string; EOFError past its end."""

    def __init__(self, data: bytes, lsb: bool = False, at: int = 0):
        self.data, self.lsb, self.at, self.end = data, lsb, 8 * at, 8 * len(data)

    def take(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        return out

    def peek(self, n: int) -> int:
        if self.at + n > self.end:
            raise EOFError("no more bits")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if self.lsb:
            return int.from_bytes(self.data[first:last], "little") >> (self.at & 7) & ((1 << n) - 1)
        return int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if v >> (n - 1) else v

    def ones(self, most: int | None = None) -> int:
        """The number of ones before the next zero, which is passed; at most ``most``, and then nothing more is."""
        count = 0
        while most is None or count < most:
            if self.at >= self.end:
                raise EOFError("no more bits")
            byte = self.data[self.at >> 3]
            bit = byte >> (self.at & 7) & 1 if self.lsb else byte >> (7 - (self.at & 7)) & 1
            self.at += 1
            if not bit:
                return count
            count += 1
        return count


class Huffman:
    """A prefix code: words of bits for symbols, highest bit first."""

    def __init__(self, words: dict[int, tuple[int, int]]):
        """``words`` gives each symbol's (code, length)."""
        self.words = words
        self.symbols = {(n, code): s for s, (code, n) in words.items()}
        if len(self.symbols) < len(words):
            raise ValueError("two symbols have one word")

    @classmethod
    def canonical(cls, counts: bytes, symbols: bytes) -> Huffman:
        """The code with so many words of 1, 2, 3, ... bits, given to the symbols in order."""
        words, code, at = {}, 0, 0
        for n, count in enumerate(counts, 1):
            if code + count > 1 << n:
                raise ValueError("there are more words than bits allow")
            for s in symbols[at : at + count]:
                words[s] = code, n
                code += 1
            at, code = at + count, code << 1
        return cls(words)

    def put(self, out: BitSink, symbol: int) -> None:
        out.put(*self.words[symbol])

    def take(self, bits: BitTap) -> int:
        code = 0
        for n in range(1, 33):
            code = code << 1 | bits.take(1)
            if (n, code) in self.symbols:
                return self.symbols[n, code]
        raise ValueError("no symbol has this word")
