"""Tables, snapshots, dumps and scripts."""
