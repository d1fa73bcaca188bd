"""SQL that the operators' queries must equal, where SQL can express them."""

from cortexlake.llm import hard_negatives, licenses, merkle


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": licenses.oracle(), "op12_merkle_manifest": merkle.oracle(), "op13_hard_negatives": hard_negatives.ORACLE}
