"""python -m vellum.cli STORE sync FOLDER | status | outline N | requirements N | references N | search QUERY | verify ID | diff A B MODE | reanalyze | reindex | vacuum"""

from __future__ import annotations

import json
import sys

from vellum.plans.runtime import session
from vellum.plans.store import Store
from vellum.service import Service, ServiceError
from vellum.sources import upstream


def main(args: list[str]) -> int:
    root, command, *rest = args
    spark = session()
    service = Service(spark, Store(spark, root))
    try:
        if command == "sync":
            found = upstream.publications(spark, rest[0]).where("form = 'txt' AND verdict = 'accepted'")
            print(json.dumps({"generation": service.store.ingest(found.selectExpr("rfc", "raw", "'' AS metadata_hash"))}))
        elif command == "status":
            print(json.dumps(service.status()))
        elif command in ("reanalyze", "reindex", "vacuum"):
            print(json.dumps({"generation": getattr(service.store, command)()}))
        else:
            calls = {"outline": lambda: service.read(rest[0]), "requirements": lambda: service.requirements(rest[0]), "references": lambda: service.references(rest[0]), "search": lambda: service.search(rest[0]), "verify": lambda: service.verify_citation(*rest), "diff": lambda: service.diff(*rest)}
            for row in calls[command]().toJSON().toLocalIterator():
                print(row)
    except ServiceError as e:
        print(json.dumps({"error": e.code, "message": str(e)}))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
