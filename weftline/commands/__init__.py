"""What is done from a shell: no data of the graph is held here."""
