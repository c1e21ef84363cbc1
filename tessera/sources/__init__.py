"""Where tables come from and go to: external files, versioned snapshots, transactions, migrations."""
