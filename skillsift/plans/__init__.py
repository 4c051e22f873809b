"""End-to-end flows, fixture bindings, landing builders, registered queries and their SQL."""
