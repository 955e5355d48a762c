"""Property graphs from TypeScript sources."""
