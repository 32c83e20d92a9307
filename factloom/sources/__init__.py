"""Reading corpora, snapshots and logs; adapters from star-schema tables."""
