"""Writers with commit, idempotence and state checks."""
