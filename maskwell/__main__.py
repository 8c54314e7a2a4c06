"""python -m maskwell [--file F | --text T] [--json]: masks one note; exit code 1 if the audit blocks it."""

from __future__ import annotations

import argparse
import json
import sys

from .operators.note import deidentify
from .policy import load_policy


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="maskwell", description=__doc__)
    parser.add_argument("--file")
    parser.add_argument("--text")
    parser.add_argument("--policy")
    parser.add_argument("--patient-key")
    parser.add_argument("--json", action="store_true")
    a = parser.parse_args(argv)
    if a.file:
        from pathlib import Path

        from .sources.files import docx_text, pdf_text

        raw = Path(a.file).read_bytes()
        kind = a.file.rpartition(".")[2].lower()
        if kind == "doc" or kind not in ("docx", "pdf", "txt", "text", "md", "rtf") and b"\0" in raw[:8192]:
            parser.error(f"can't read {a.file}")
        text = {"docx": docx_text, "pdf": pdf_text}.get(kind, lambda r: r.decode("utf-8", "replace"))(raw)
    else:
        text = a.text if a.text is not None else sys.stdin.read()
    r = deidentify(text, load_policy(a.policy), a.patient_key)
    counts: dict[str, int] = {}
    for s in r.spans:
        counts[s.category] = counts.get(s.category, 0) + 1
    if a.json:
        print(json.dumps({"masked_text": r.masked, "mapping": [e._asdict() for e in r.entries], "summary": counts, "review_queue": [{"placeholder": p, "text": s.text, "reason": why} for s, p, why in r.review]}, indent=2))
    else:
        print(r.masked)
        for e in r.entries:
            print(f"  {e.placeholder}  {e.category}  {', '.join(e.surfaces[:4])}")
        for f in r.findings:
            print(f"  ! {f.category} [{f.detector}]")
        print(json.dumps(counts))
    return int(r.blocked)


if __name__ == "__main__":
    sys.exit(main())
