"""functions of the retrieval and grounding engine."""
