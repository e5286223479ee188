"""Pair compatibility of merge-type tokens: do two tokens stay apart when their texts are merged together?"""

from __future__ import annotations

from typing import Callable, Optional

_NEVER = 1 << 62


class PairTest:
    """Answers whether merging the text of ``left + right`` gives back exactly these two tokens.

    ``split`` has the two parts that a token's last merge joined (absent for
    tokens made without a merge), ``made`` the rank of that merge, ``rank`` the
    rank of merging two neighbours (None: they do not merge). Smaller ranks
    merge first, equal ranks from the left.

    Seen backwards, the token made last at the boundary comes apart first; what
    touches the boundary is then its inner part. The tokens are incompatible if
    at any such moment the two touching parts would have merged across the
    boundary before the next recorded merge happened.
    """

    def __init__(self, split: dict, made: dict, rank: Callable[[str, str], Optional[int]], keep: int):
        self.split, self.made, self.rank, self.keep = split, made, rank, keep
        self.known: dict[tuple[str, str], bool] = {}

    def __call__(self, left: str, right: str) -> bool:
        known = self.known
        ok = known.get((left, right))
        if ok is None:
            if len(known) >= self.keep:
                known.clear()
            ok = known[left, right] = self._apart(left, right)
        return ok

    def reachable(self, token: str) -> bool:
        """True if merging the text of a token gives the token: its two parts stay apart until its own merge."""
        return token not in self.split or self._apart(*self.split[token], self.made[token])

    def _apart(self, left: str, right: str, before: int = _NEVER) -> bool:
        """``before``: a merge across the boundary must not come before this rank."""
        split, made = self.split, self.made
        while True:
            across = self.rank(left, right)
            if across is not None and across < before:
                return False
            l_made, r_made = made.get(left, -1), made.get(right, -1)
            if l_made < 0 and r_made < 0:
                return True
            if l_made > r_made:
                before, left = l_made, split[left][1]
            else:  # of equal ranks the left merge came first, and one across comes before the right one
                before, right = r_made + 1, split[right][0]
