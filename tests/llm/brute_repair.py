"""Plain counterpart of the conversation repair: shortest edits by label-setting search."""

import hashlib
import heapq
import re
import zlib

BLANK = re.compile("[\\x20\\x09-\\x0D]")


def damage(rows):
    """(conv_id, turn, role, text) rows after damage, in stored order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(faults, roles):
    """Least (cost, audit) over all edits whose role initials match, and their turns.

    Every partial edit is a node (rows done, initials so far as a state), and nodes leave
    a heap in the order of cost and then audit.
    """
    grammar = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, turns = heapq.heappop(heap)
        if k == len(faults) and state in ("", "a"):
            return cost, audit, turns
        if (k, state) in done:
            continue
        done.add((k, state))
        for role in ("user", "assistant"):
            if role[0] in grammar[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", k, grammar[state][role[0]], (*turns, (role, None))))
        if k < len(faults):
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, state, turns))
            if faults[k] not in ("blank", "duplicate"):
                extra = faults[k] == "truncated"
                if roles[k][:1] in grammar[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", k + 1, grammar[state][roles[k][:1]], (*turns, (roles[k], k))))
                for role in ("user", "assistant"):
                    if role[0] in grammar[state]:
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", k + 1, grammar[state][role[0]], (*turns, (role, k))))


def repair(rows, ids):
    """Result rows of the contract from rows after damage."""
    out = []
    for conv in sorted(set(ids), key=lambda c: (c is not None, c or 0)):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        seen, faults = set(), []
        for _, _, role, text in own:
            left = BLANK.sub("", text)
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        roles = [r[2] for r in own]
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        cost, audit, left = cheapest(faults, roles)
        text = "\n".join(f"{role}:{'' if k is None else own[k][3]}" for role, k in left)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha))
    return out
