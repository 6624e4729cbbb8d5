"""DataFrame operators: practice statistics, block extraction, recognition, ledger and stores."""
