"""Row-level security: policies, guards, relationships, field access and decisions."""
