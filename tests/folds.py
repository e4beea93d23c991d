"""The rules of the ordered operators as plain walks over one group."""


def batch_anchors(rows, window=5.0, max_lines=1000, max_bytes=262144):
    """rows: (ts, n_bytes) -> position of the first row of each row's batch."""
    out, start, count, size, first_ts = [], -1, 0, 0, 0.0
    for i, (ts, n) in enumerate(rows):
        fresh = count == 0 or count >= max_lines or size + n >= max_bytes or (ts != 0 and ts - first_ts > window)
        if fresh:
            start, count, size, first_ts = i, 1, n, ts
        else:
            count, size = count + 1, size + 1 + n
        out.append(start)
    return out


def limiter(clocks, burst, window):
    """clocks -> whether each event passes."""
    out, since, used = [], None, 0
    for now in clocks:
        if burst <= 0:
            out.append(True)
            continue
        if since is None or now - since > window:
            since, used = now, 0
        out.append(used < burst)
        used += used < burst
    return out


def dmesg_keep(lines):
    """lines: (is_error, stamped, ts, header or '') -> kept?"""
    out, last_ts, last_header = [], 0.0, ""
    for error, stamped, ts, header in lines:
        if error:
            if stamped and ts > 0:
                last_ts = ts
            if header:
                last_header = header
            out.append(True)
        elif not last_header:
            out.append(False)
        elif not stamped:
            out.append(True)
        else:
            a, b = last_header.strip(), header.strip()
            out.append(bool(header and ts > 0 and ts - last_ts <= 5.0 and a and b
                            and (a.startswith(b) or b.startswith(a))))
    return out
