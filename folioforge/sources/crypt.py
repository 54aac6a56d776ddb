"""The standard encryption of document files: keys, passwords, ciphers."""

from __future__ import annotations

import hashlib
import struct

#: Fixed value: the bytes that pad a password.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    state, j = list(range(256)), 0
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) & 255
        state[i], state[j] = state[j], state[i]
    out, i, j = bytearray(), 0, 0
    for byte in data:
        i = (i + 1) & 255
        j = (j + state[i]) & 255
        state[i], state[j] = state[j], state[i]
        out.append(byte ^ state[(state[i] + state[j]) & 255])
    return bytes(out)


def _double(x: int) -> int:
    return (x << 1 ^ 0x11B) if x & 0x80 else x << 1


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution of AES and its inverse, from the field itself."""
    power, log, x = [0] * 256, [0] * 256, 1
    for k in range(255):
        power[k], log[x] = x, k
        x ^= _double(x)
    box = [0] * 256
    for v in range(256):
        inverse = power[(255 - log[v]) % 255] if v else 0
        box[v] = 0x63
        for turn in range(5):
            box[v] ^= (inverse << turn | inverse >> (8 - turn)) & 255
    back = [0] * 256
    for v, s in enumerate(box):
        back[s] = v
    return box, back


BOX, BACK = _boxes()


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = _double(a), b >> 1
    return out


class AES:
    """Blocks of 16 bytes under a key of 16 or 32."""

    def __init__(self, key: bytes):
        n, words, factor = len(key) // 4, [list(key[k : k + 4]) for k in range(0, len(key), 4)], 1
        self.rounds = n + 6
        for k in range(n, 4 * (self.rounds + 1)):
            word = list(words[-1])
            if k % n == 0:
                word = [BOX[b] for b in word[1:] + word[:1]]
                word[0] ^= factor
                factor = _double(factor)
            elif n > 6 and k % n == 4:
                word = [BOX[b] for b in word]
            words.append([a ^ b for a, b in zip(words[k - n], word, strict=True)])
        self.keys = [sum(words[4 * r : 4 * r + 4], []) for r in range(self.rounds + 1)]

    def _mixed(self, s: list[int], factors: tuple[int, ...]) -> list[int]:
        return [_times(s[4 * c], factors[-r % 4]) ^ _times(s[4 * c + 1], factors[(1 - r) % 4]) ^ _times(s[4 * c + 2], factors[(2 - r) % 4]) ^ _times(s[4 * c + 3], factors[(3 - r) % 4]) for c in range(4) for r in range(4)]

    def encrypt(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.keys[0], strict=True)]
        for r in range(1, self.rounds + 1):
            s = [BOX[s[(4 * (c + row) + row) % 16]] for c in range(4) for row in range(4)]
            s = self._mixed(s, (2, 3, 1, 1)) if r < self.rounds else s
            s = [a ^ b for a, b in zip(s, self.keys[r], strict=True)]
        return bytes(s)

    def decrypt(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.keys[-1], strict=True)]
        for r in reversed(range(self.rounds)):
            s = [BACK[s[(4 * (c - row) + row) % 16]] for c in range(4) for row in range(4)]
            s = [a ^ b for a, b in zip(s, self.keys[r], strict=True)]
            s = self._mixed(s, (14, 11, 13, 9)) if r else s
        return bytes(s)


def cbc_decrypt(key: bytes, data: bytes, start: bytes | None = None, padded: bool = True) -> bytes:
    """The vector leads the data unless given; data that cannot be of this kind is returned as it is."""
    body = data if start is not None else data[16:]
    last = start if start is not None else data[:16]
    if len(last) < 16 or len(body) % 16 or not body:
        return data
    engine, out = AES(key), bytearray()
    for k in range(0, len(body), 16):
        out += bytes(a ^ b for a, b in zip(engine.decrypt(body[k : k + 16]), last, strict=True))
        last = body[k : k + 16]
    if padded:
        return bytes(out[: -out[-1]]) if 1 <= out[-1] <= 16 else data
    return bytes(out)


def cbc_encrypt(key: bytes, data: bytes, start: bytes) -> bytes:
    engine, out, last = AES(key), bytearray(), start
    for k in range(0, len(data), 16):
        last = engine.encrypt(bytes(a ^ b for a, b in zip(data[k : k + 16], last, strict=True)))
        out += last
    return bytes(out)


def key_bytes(length: int) -> int:
    """Bytes of a key whose length is said in bits, or by some writers in bytes."""
    return max(5, min(16, length // 8 if length >= 40 else length))


def file_key(password: bytes, owner: bytes, permissions: int, file_id: bytes, revision: int, length: int, metadata: bool = True) -> bytes:
    """The key of revisions 2 to 4."""
    size = 5 if revision == 2 else key_bytes(length)
    digest = hashlib.md5((password + PADDING)[:32] + owner[:32] + struct.pack("<I", permissions & 0xFFFFFFFF) + file_id + (b"" if metadata or revision < 4 else b"\xff" * 4)).digest()
    for _ in range(50 if revision >= 3 else 0):
        digest = hashlib.md5(digest[:size]).digest()
    return digest[:size]


def user_entry(key: bytes, file_id: bytes, revision: int) -> bytes:
    """What the file holds if key is right: all of it in revision 2, the first 16 bytes otherwise."""
    if revision == 2:
        return rc4(key, PADDING)
    value = rc4(key, hashlib.md5(PADDING + file_id).digest())
    for k in range(1, 20):
        value = rc4(bytes(b ^ k for b in key), value)
    return value


def user_password(owner_password: bytes, owner: bytes, revision: int, length: int) -> bytes:
    """The padded user password that an owner password unlocks."""
    size, digest = (5 if revision == 2 else key_bytes(length)), hashlib.md5((owner_password + PADDING)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        digest = hashlib.md5(digest).digest()
    value = owner[:32]
    for k in range(19, -1, -1) if revision >= 3 else (0,):
        value = rc4(bytes(b ^ k for b in digest[:size]), value)
    return value


def object_key(key: bytes, number: int, generation: int, aes: bool) -> bytes:
    salted = key + struct.pack("<I", number)[:3] + struct.pack("<I", generation)[:2] + b"sAlT" * aes
    return hashlib.md5(salted).digest()[: min(16, len(key) + 5)]


def hardened(password: bytes, salt: bytes, user: bytes = b"", revision: int = 6) -> bytes:
    """The digest of revisions 5 and 6."""
    key = hashlib.sha256(password + salt + user).digest()
    if revision < 6:
        return key
    turn = 0
    while True:
        block = cbc_encrypt(key[:16], (password + key + user) * 64, key[16:32])
        key = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(block[:16]) % 3](block).digest()
        turn += 1
        if turn >= 64 and block[-1] <= turn - 32:
            return key[:32]


def authenticate(password: bytes, entries: dict, file_id: bytes) -> tuple[int, bytes | None]:
    """(status, file key): 0 wrong, bit 2 the user password, bit 4 the owner password; entries are plain values."""
    revision, owner, user = entries["R"], entries["O"], entries["U"]
    if revision >= 5:
        password = password[:127]
        for bit, hashed, extra, wrapped in ((2, user, b"", "UE"), (4, owner, user[:48], "OE")):
            if hardened(password, hashed[32:40], extra, revision) == hashed[:32]:
                return bit, cbc_decrypt(hardened(password, hashed[40:48], extra, revision), entries[wrapped][:32], bytes(16), padded=False)
        return 0, None
    length = entries.get("Length", 40)
    for bit, candidate in ((2, password), (4, user_password(password, owner, revision, length))):
        key = file_key(candidate, owner, entries["P"], file_id, revision, length, entries.get("EncryptMetadata", True))
        size = 32 if revision == 2 else 16
        if user_entry(key, file_id, revision)[:size] == user[:size]:
            return bit, key
    return 0, None
