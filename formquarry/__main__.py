"""``python -m formquarry ROOT``: scan a dump and print the number of forms, or save its index."""

from __future__ import annotations

import argparse

from formquarry.session import local_session, stored
from formquarry.sources import dump, indexes


def main() -> int:
    parser = argparse.ArgumentParser(prog="formquarry", description="Scan an unpacked dump for forms.")
    parser.add_argument("root", help="folder of the dump")
    parser.add_argument("--mode", choices=["config", "external"], default="config", help="layout of the folder")
    parser.add_argument("--save", metavar="FOLDER", help="write the index there, as tables in JSON lines")
    parser.add_argument("--export", metavar="FOLDER", help="write the index there, as one JSON document")
    parser.add_argument("--no-elem-only", action="store_true", help="leave out forms without a code module")
    args = parser.parse_args()
    spark = local_session()
    forms = stored(dump.scan_forms(spark, args.root, args.mode, not args.no_elem_only), "forms")
    print(f"forms: {forms.count()}")
    for folder, write in ((args.save, indexes.save_scan_index), (args.export, indexes.export_scan_index)):
        if folder:
            write(forms, folder)
            print(f"index: {folder}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
