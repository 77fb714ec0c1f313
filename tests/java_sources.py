"""Java sources used by several tests."""

SERVICE = r'''package com.acme.service;

import com.acme.repository.OrderRepository;
import java.util.List;

/** Places orders. */
public class OrderService extends BaseService implements Auditable {
    private OrderRepository repo;
    public static final int MAX = 3;

    public List<Order> place(Order order) {
        Helper helper = new Helper();
        helper.check(order);
        this.repo.save(order);
        audit();
        return Factory.getInstance().list();
    }
}
'''

CONTROLLER = r'''/* License text
 * more */
package com.acme.web;

import java.util.*;
import static com.acme.Util.help;

/**
 * Serves orders.
 * @author x
 */
@RestController
@RequestMapping(value = {"/api"}, path="/api")
@SuppressWarnings({"unchecked", "rawtypes"})
public class OrderController<T extends Comparable<T>> extends Base<T> implements Serializable, java.lang.Comparable<Foo<Bar>> {
    private static final Map<String, List<Foo>> CACHE = new HashMap<String, List<Foo>>(), OTHER = null;
    int[] nums = {1, 2, 3};
    private Runnable r = new Runnable() { public void run() { foo(); } }; 
    @Autowired private OrderService svc;
    static { int z = 5; init(z); }
    static class Inner { int q; @GetMapping("/inner") void im() {} }
    public OrderController(OrderService svc) { this.svc = svc; super.foo(); }
    // first
    // second
    @GetMapping("/x")
    public <R> List<R> get(@RequestParam("a") final String a, int[] b, Map<String, Integer> m, Object... rest) throws IOException {
        for (int i = 0, j = 1; i < b.length; i++) { svc.handle(i, "}{;"); }
        for (String s : list) use(s);
        String t = """
            text { block " ;
            """;
        list.stream().map(x -> { Foo f = new Foo<>(x); return f.bar(); }).collect(Collectors.toList());
        try (Reader rd = open(); Writer w = out()) { a.b.c = 1; } catch (Exception e) { log.error("x", e); }
        char c = '{';
        if (a instanceof String str) { return null; }
        Object o = new Object() { void inner() { deep.call(); } };
        new Thread(this::run).start();
        int x = a.size() < 3 ? 1 : 2, y = 3;
        return builder().one(1)
            .two(2)
            .three();
    }
    @PostMapping
    protected abstract void nothing();
    @RequestMapping(value="/y", method=RequestMethod.POST) String y() { return Const.A + this.name + "s".length(); }
}
enum Color implements Shape {
    RED(1) { int v() { return 1; } }, /** green */ GREEN(2), @Deprecated BLUE;
    private final int code;
    Color(int c) { code = c; }
    int code() { return code; }
}
interface Shape extends A, B { int SIDES = 4; double area(); default void d() { area(); } }
@interface Mark { String value() default "x"; }
record Point(int x, int y) { int sum() { return x + y; } }
'''

BEANS = r'''package p;
@Data
public class Bean {
    private String name;
    private boolean isOpen;
    private final int n = 0;
    static int s;
    public String getName() { return name; }
}
@Slf4j
class L { void go() { log.info("x"); } }
class Broken { void m() { call(
'''

SPRING = {
    "src/app/App.java": """package com.acme;
@SpringBootApplication
public class App { }
""",
    "src/app/config/Wiring.java": """package com.acme.config;
import com.acme.other.B;
@Configuration
public class Wiring {
    @Bean
    public A a(B b, @Qualifier("x") List<C> c) { return null; }
}
""",
    "src/app/b/B.java": "package com.acme.b; public class B { }",
    "src/app/other/B.java": "package com.acme.other; public class B { }",
    "src/app/impl/Impl.java": "package com.acme.impl; public class Impl extends X implements A<Foo> { }",
    "src/app/use/Use.java": """package com.acme.service;
@Configuration class Use { @Bean D d(A a) { return null; } }
""",
}
