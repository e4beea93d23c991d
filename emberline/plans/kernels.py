"""Array helpers that run inside tasks on one block of a group.

A group (a source) is a sequence of rows; anchored grouping starts a new batch
at the first row and then at the *successor* of each start, where the successor
of row i depends only on the rows from i on. So a block of consecutive rows is a
step function: given where the first start falls in the block, it tells where
the first start falls in the next one. Step functions compose, which is what lets
the blocks be worked on independently.

A step function is three arrays (``at``, ``to``, ``anchor``), ``at`` ascending:
a position ``p`` selects the first entry with ``at > p``; the position becomes
``to`` and the open batch is the one started by row ``anchor``. Without such an
entry the block starts no batch and the state passes through unchanged. ``reach``
is the largest position a block can be entered with, so only the entries up to
there are kept, which keeps the functions short however long the block is.

This module must not import anything from the package: it is shipped by value.
"""

import numpy as np
import pandas as pd


# --- successors ------------------------------------------------------------

def capped_successors(ts, size, n, window, max_lines, max_bytes):
    """First row after each of rows ``0..n-1`` that does not join its batch.

    ``ts`` and ``size`` also hold the rows that follow the block, up to the line
    cap. A row is refused when the batch has ``max_lines`` rows, when its text
    would bring the joined text to ``max_bytes``, or when it is stamped (not 0)
    more than ``window`` after the first row of the batch.
    """
    total = len(ts)
    first = np.arange(n)
    limit = np.minimum(first + max_lines, total)
    joined = np.cumsum(size + 1)
    before = np.concatenate(([0], joined[:-1]))[:n]
    by_bytes = np.searchsorted(joined, before + max_bytes + 2, side="left")
    limit = np.minimum(limit, np.maximum(by_bytes, first + 1))
    compared = np.where(ts == 0.0, -np.inf, ts)
    result = limit.copy()
    open_rows, step = first, 1
    while len(open_rows):
        open_rows = open_rows[open_rows + step < limit[open_rows]]
        late = compared[open_rows + step] - ts[open_rows] > window
        hit = open_rows[late]
        result[hit] = hit + step
        open_rows = open_rows[~late]
        step += 1
    return result


def clock_successors(clock, window):
    """First row after each row whose clock is more than ``window`` later (clock ascending)."""
    return np.searchsorted(clock, clock + window, side="right")


# --- step functions --------------------------------------------------------

def squeeze(at, to, anchor):
    """Merge neighbouring entries with the same outcome."""
    if len(at) == 0:
        return at, to, anchor
    last = np.append((to[1:] != to[:-1]) | (anchor[1:] != anchor[:-1]), True)
    return at[last], to[last], anchor[last]


def block_steps(nxt, entries, at, leave_to, ordinal):
    """Step function of a block: follow each of the first ``entries`` rows to its
    last start inside the block."""
    n = len(nxt)
    last = np.where(nxt < n, nxt, np.arange(n))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    last = last[:entries]
    return squeeze(at[:entries], leave_to[last], ordinal[last])


def apply_steps(steps, pos, anchor):
    at, to, start, _ = steps
    i = np.searchsorted(at, pos, side="right")
    return (float(to[i]), int(start[i])) if i < len(at) else (pos, anchor)


def compose_steps(first, second):
    """The step function of two neighbouring blocks taken as one."""
    (at, to, anchor, reach), (at2, to2, anchor2, _) = first, second
    i = np.searchsorted(at2, to, side="right")
    hit = i < len(at2)
    j = np.where(hit, i, 0)
    # A position past the first block's last entry is decided by the second block.
    extra = at2 > at[-1]
    since = np.concatenate((at[-1:], at2[extra]))[:-1]
    extra[extra] = since <= reach
    return (
        *squeeze(
            np.concatenate((at, at2[extra])),
            np.concatenate((np.where(hit, to2[j], to), to2[extra])),
            np.concatenate((np.where(hit, anchor2[j], anchor), anchor2[extra])),
        ),
        reach,
    )


def _steps_of(row):
    return (
        np.asarray(row["at"], dtype=float),
        np.asarray(row["to"], dtype=float),
        np.asarray(row["anchor"], dtype=np.int64),
        float(row["reach"]),
    )


def _steps_frame(pdf, names, steps):
    head = {k: [pdf[k].iloc[0]] for k in names}
    return pd.DataFrame({**head, **{c: [v] for c, v in zip(("at", "to", "anchor", "reach"), steps)}})


# --- the two block types ---------------------------------------------------
# Each gives (rows, ordinal, nxt, at, leave_to, reach) for the rows a block owns.

def capped_block(pdf, window, max_lines, max_bytes):
    """Positions are row numbers of the group; the block also sees the next rows."""
    pdf = pdf.sort_values("ordinal")
    own = int(pdf["own"].sum())
    mine = pdf["ordinal"].to_numpy()[:own]
    nxt = capped_successors(
        pdf["ts"].to_numpy(), pdf["n_bytes"].to_numpy(), own, window, max_lines, max_bytes
    )
    start = mine[0] if own else 0
    return pdf.iloc[:own], mine, nxt, mine + 1.0, (start + nxt).astype(float), float(start + max_lines - 1)


def clock_block(pdf):
    """Positions are clock values: a start is the first row later than the position."""
    pdf = pdf.sort_values("ordinal")
    clock = pdf["clock"].to_numpy()
    window = int(pdf["window"].iloc[0]) if len(pdf) else 0
    nxt = clock_successors(clock, window)
    reach = float(clock[0] + window) if len(pdf) else 0.0
    return pdf, pdf["ordinal"].to_numpy(), nxt, clock.astype(float), (clock + window).astype(float), reach


# --- functions for applyInPandas -------------------------------------------

def steps_of_block(block, keys):
    def run(pdf):
        _, ordinal, nxt, at, leave_to, reach = block(pdf)
        if not len(ordinal):
            return pd.DataFrame(columns=[*keys, "block", "at", "to", "anchor", "reach"])
        entries = min(len(at), int(np.searchsorted(at, reach, side="right")) + 1)
        steps = block_steps(nxt, entries, at, leave_to, ordinal)
        return _steps_frame(pdf, [*keys, "block"], (*steps, reach))

    return run


def steps_of_group(keys, part, whole):
    """Compose the parts of a larger block, in order."""

    def run(pdf):
        pdf = pdf.sort_values(part)
        total = None
        for _, row in pdf.iterrows():
            steps = _steps_of(row)
            total = steps if total is None else compose_steps(total, steps)
        return _steps_frame(pdf, [*keys, whole], total)

    return run


def _walk(pdf, keys, part, pos, anchor):
    pdf = pdf.sort_values(part)
    positions, anchors = [], []
    for _, row in pdf.iterrows():
        positions.append(pos)
        anchors.append(anchor)
        pos, anchor = apply_steps(_steps_of(row), pos, anchor)
    out = pdf[[*keys, part]].copy()
    out["pos"], out["open"] = positions, anchors
    return out


def walk_from_start(keys, part):
    """State on entry to every part of a group, from the beginning."""

    def run(pdf):
        return _walk(pdf, keys, part, -np.inf, -1)

    return run


def walk_from_state(keys, part):
    """State on entry to every part, from the state on entry to the larger block."""

    def run(pdf, state):
        if not len(pdf) or not len(state):
            return pd.DataFrame(columns=[*keys, part, "pos", "open"])
        return _walk(pdf, keys, part, float(state["pos"].iloc[0]), int(state["open"].iloc[0]))

    return run


def anchors_of_block(block, keys, order):
    """Give every row of a block the ordinal of the row that started its batch."""
    mark = anchors_of_group(block, keys, order)

    def run(pdf, state):
        if not len(pdf) or not len(state):
            return pd.DataFrame(columns=[*keys, order, "ordinal", "anchor"])
        return mark(pdf, float(state["pos"].iloc[0]), int(state["open"].iloc[0]))

    return run


def anchors_of_whole(block, keys, order):
    """The same for a group that is a single block."""
    mark = anchors_of_group(block, keys, order)
    return lambda pdf: mark(pdf, -np.inf, -1)


def anchors_of_group(block, keys, order):
    def run(pdf, pos, begun):
        rows, ordinal, nxt, at, _, _ = block(pdf)
        n = len(ordinal)
        anchor = np.full(n, begun, dtype=np.int64)
        starts = []
        i = int(np.searchsorted(at, pos, side="right"))
        while i < n:
            starts.append(i)
            i = int(nxt[i])
        if starts:
            is_start = np.zeros(n, dtype=np.int64)
            is_start[starts] = np.arange(1, len(starts) + 1)
            seen = np.maximum.accumulate(is_start)
            anchor = np.where(seen > 0, ordinal[np.array(starts)[np.maximum(seen - 1, 0)]], anchor)
        out = rows[[*keys, order, "ordinal"]].copy()
        out["anchor"] = anchor
        return out

    return run


# --- small helpers of other modules ----------------------------------------

def one_row_per_source(batches):
    for pdf in batches:
        yield pd.DataFrame({"source": pdf["source"].unique()})
