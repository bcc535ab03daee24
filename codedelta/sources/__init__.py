"""Sources: driver tables, derived code pairs, request intake and stores."""
