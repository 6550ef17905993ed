"""End-to-end flows and the catalog of registered queries."""
