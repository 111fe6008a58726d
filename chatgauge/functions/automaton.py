"""An Aho-Corasick automaton over UTF-8 bytes, as flat arrays, run over many texts at once.

States are numbers, the next state is one lookup by state and byte kind (bytes that no name
holds share kind 0, which leads back to the start). Every text is read once, whatever the
number of names: texts are cut into windows that overlap by the longest name, and all windows
of a batch take a step together.
"""

import unicodedata

import numpy as np

#: Bytes of a window; the overlap comes on top.
WINDOW = 1024


def char_starts(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero((data & 0xC0) != 0x80)


_word_chars = {}


def _is_word(code: int) -> bool:
    found = _word_chars.get(code)
    if found is None:
        found = _word_chars[code] = unicodedata.category(chr(code))[0] in "LN" or code == 95
    return found


_ASCII_WORD = np.array([_is_word(c) for c in range(128)])


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a letter, a number or ``_``."""
    starts = char_starts(data)
    size = np.diff(np.append(starts, len(data)))
    word = np.zeros(len(starts), bool)
    first = data[starts]
    plain = first < 128
    word[plain] = _ASCII_WORD[first[plain]]
    wide = np.flatnonzero(~plain)
    if len(wide):
        at, n = starts[wide], size[wide]
        code = first[wide].astype(np.int64) & np.where(n == 2, 0x1F, np.where(n == 3, 0x0F, 0x07))
        for k in (1, 2, 3):
            more = n > k
            code[more] = code[more] << 6 | (data[at[more] + k] & 0x3F)
        distinct, number = np.unique(code, return_inverse=True)
        word[wide] = np.array([_is_word(int(c)) for c in distinct])[number]
    return np.repeat(word, size)


class Automaton:
    """Names (non-empty UTF-8 byte strings, each once) in order of preference."""

    def __init__(self, names):
        self.lengths = np.array([len(n) for n in names], np.int64)
        self.longest = int(self.lengths.max(initial=1))
        used = sorted(set(b"".join(names)))
        self.kind = np.zeros(256, np.uint8 if len(used) < 256 else np.int16)
        self.kind[used] = np.arange(1, len(used) + 1)
        children, level_of, name_at = [{}], [0], [-1]
        for number, name in enumerate(names):
            state = 0
            for kind in self.kind[list(name)].tolist():
                below = children[state].get(kind)
                if below is None:
                    below = children[state][kind] = len(children)
                    children.append({})
                    level_of.append(level_of[state] + 1)
                    name_at.append(-1)
                state = below
            name_at[state] = number
        n = len(children)
        self.step = np.zeros((n, len(used) + 1), np.int32)
        self.name = np.array(name_at, np.int32)
        #: The state of the next shorter name that also ends here, 0 for none.
        self.shorter = np.zeros(n, np.int32)
        fail, by_level = np.zeros(n, np.int32), [[] for _ in range(max(level_of) + 1)]
        for state, level in enumerate(level_of):
            by_level[level].append(state)
        for states in by_level:
            states = np.array(states)
            if states[0]:
                self.step[states] = self.step[fail[states]]
                behind = fail[states]
                self.shorter[states] = np.where(self.name[behind] >= 0, behind, self.shorter[behind])
            for state in states.tolist():
                for kind, below in children[state].items():
                    # where the state fails to, the same byte leads on; set before this row is changed
                    fail[below] = self.step[fail[state], kind] if state else 0
            for state in states.tolist():
                for kind, below in children[state].items():
                    self.step[state, kind] = below
        self.ends = (self.name >= 0) | (self.shorter > 0)

    @property
    def nbytes(self):
        return self.step.nbytes + self.name.nbytes + self.shorter.nbytes + self.ends.nbytes

    def hits(self, data: np.ndarray, offsets: np.ndarray):
        """(text, name, start, end) of every occurrence of every name inside one text."""
        size = np.diff(offsets)
        windows = -(-size // WINDOW)
        text = np.repeat(np.arange(len(size)), windows)
        own = offsets[text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows))
        # a name that ends in a window may begin in the one before
        start = np.maximum(own - (self.longest - 1), offsets[text])
        stop = np.minimum(own + WINDOW, offsets[text + 1])
        order = np.argsort(start - stop, kind="stable")  # the longest first, so that live windows come first
        text, own, start, stop = text[order], own[order], start[order], stop[order]
        live, kinds = np.searchsorted(start - stop, -np.arange(int((stop - start).max(initial=0))), "left"), self.kind[data]
        state, found = np.zeros(len(text), np.int32), []
        for k, n in enumerate(live.tolist()):
            at = start[:n] + k
            now = state[:n] = self.step[state[:n], kinds[at]]
            ended = np.flatnonzero(self.ends[now] & (at >= own[:n]))
            if len(ended):
                found.append((text[ended], now[ended].astype(np.int64), at[ended] + 1))
        if not found:
            return (np.zeros(0, np.int64),) * 4
        text, state, end = (np.concatenate(c) for c in zip(*found))
        out = []
        while len(state):
            name = self.name[state]
            named = name >= 0
            out.append((text[named], name[named].astype(np.int64), end[named] - self.lengths[name[named]], end[named]))
            state = self.shorter[state]
            text, state, end = text[state > 0], state[state > 0], end[state > 0]
        return tuple(np.concatenate(c) for c in zip(*out))

    def first_words(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text the least number of a name that it holds as a whole word, -1 for none."""
        least = np.full(len(offsets) - 1, len(self.lengths), np.int64)
        text, name, start, end = self.hits(data, offsets)
        if len(text):
            word = word_bytes(data)
            before = (start > offsets[text]) & word[np.maximum(start - 1, 0)]
            after = (end < offsets[text + 1]) & word[np.minimum(end, len(data) - 1)]
            whole = ~before & ~after
            np.minimum.at(least, text[whole], name[whole])
        return np.where(least < len(self.lengths), least, -1)
